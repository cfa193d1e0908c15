"""The prefix trie of conversations: balanced parentheses of each shard, whose shared spines are then merged."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.session import cut, small_side

#: Turns of a shard (about); parentheses of a block of excesses; ids in a piece of a node's list.
SHARD, BLOCK, PIECE = 16_384, 64, 4_096
#: Name of the root; a node's name is a digest of its parent's and its last turn.
ROOT = bytes(16)
PATH = "array<struct<turn:binary,words:int>>"


class BalancedParentheses:
    """A tree as a string of parentheses (1 opens), one pair for each node in preorder.

    The excess after a place is how many pairs are open there. Blocks of excesses have their minima, pairs of blocks the
    minima of these, and so on: the pair of an opening one is the first place behind it with less excess, found in its own
    block, or by climbing to the first block with a small enough minimum and down again. A leaf is a pair "()".
    """

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.astype(bool)
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        self.opened = np.cumsum(self.bits)
        self.leaf = np.zeros(len(bits), bool)  # the opening half of "()"
        self.leaf[:-1] = self.bits[:-1] & ~self.bits[1:]
        size = 1 << max(0, (-(-len(bits) // BLOCK) - 1).bit_length())
        padded = np.full(size * BLOCK, len(bits) + 1)
        padded[: len(bits)] = self.excess
        self.padded, level = padded, padded.reshape(size, BLOCK).min(axis=1)
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).min(axis=1)
            levels.append(level)
        self.least = np.concatenate(levels)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in levels])])

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def _scan(self, start: np.ndarray, stop: np.ndarray, less: np.ndarray) -> np.ndarray:
        """The first place in [start, stop), at most a block long, with an excess below `less`; -1 if there is none."""
        found, left = np.full(len(start), -1), np.arange(len(start))
        for step in range(BLOCK):
            left = left[start[left] + step < stop[left]]
            if not len(left):
                break
            hit = self.padded[start[left] + step] < less[left]
            found[left[hit]] = start[left[hit]] + step
            left = left[~hit]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening one."""
        less = self.excess[opens]
        out = self._scan(opens + 1, (opens // BLOCK + 1) * BLOCK, less)
        far = np.flatnonzero(out < 0)
        if len(far):
            less, at, level = less[far], opens[far] // BLOCK + 1, np.zeros(len(far), np.int64)
            going = np.arange(len(far))
            even = at % 2 == 0  # the first block of a pair: look at the pair as a whole
            while len(going):
                up = going[(at[going] % 2 == 0) & (level[going] + 2 < len(self.offset)) & even[going]]
                at[up], level[up] = at[up] >> 1, level[up] + 1
                even[up] = at[up] % 2 == 0
                going = going[self.least[self.offset[level[going]] + at[going]] >= less[going]]
                at[going] += 1
                even[going] = True
            while level.any():
                down = np.flatnonzero(level)
                level[down] -= 1
                at[down] *= 2
                at[down] += self.least[self.offset[level[down]] + at[down]] >= less[down]
            out[far] = self._scan(at * BLOCK, (at + 1) * BLOCK, less)
        return out

    def leaves(self, opens: np.ndarray, closes: np.ndarray, leaf: np.ndarray | None = None) -> np.ndarray:
        """How many leaves lie between each opening place and its close."""
        rank = np.concatenate([[0], np.cumsum(self.leaf if leaf is None else leaf)])
        return rank[closes] - rank[opens]


def range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair, low < high."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(tables[k][low[own]], tables[k][high[own] - (1 << int(k))])
    return out


def common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shard_nodes(paths: list[list[bytes]], words: list[list[int]], members: list[int], first: list[int], before: list[bytes] | None, after: list[bytes] | None) -> dict[str, list | np.ndarray]:
    """The nodes of one shard: distinct paths in order, each with its members and the least of their ids.

    before, after: the paths right before and behind the shard's, which share its outer nodes: counts of such a node are
    those of this shard, and what the shards find adds up. A node counts as a child and with its words only in the first
    shard that holds it.
    """
    names, parent, depth, tokens, bits = [ROOT], [-1], [0], [0], [1]
    ends, stack = [], [0]
    old: list[bytes] = []
    for path, sizes in zip(paths, words, strict=True):
        shared = common(old, path)
        bits += [0] * (len(stack) - 1 - shared) + [1] * (len(path) - shared)
        del stack[shared + 1 :]
        for d in range(shared, len(path)):
            parent.append(stack[-1])
            stack.append(len(names))
            names.append(sha256(names[parent[-1]] + path[d]).digest()[:16])
            depth.append(d + 1)
            tokens.append(sizes[d])
        ends.append(stack[-1])
        old = path
    tree = BalancedParentheses(np.array(bits + [0] * len(stack)))
    opens = tree.opens()
    closes = tree.find_close(opens)
    low, high = np.arange(len(names)), np.arange(len(names)) + (closes - opens + 1) // 2

    left = common(before, paths[0]) if before is not None else -1
    right = common(after, paths[-1]) if after is not None else -1
    depths, up = np.array(depth), np.array(parent)
    on_left, on_right = np.zeros(len(names), bool), np.zeros(len(names), bool)
    on_left[: left + 1] = True  # the first path's nodes are the first in preorder
    on_right[stack[: right + 1]] = True
    leaf = tree.leaf.copy()
    if right == len(paths[-1]):  # the next shard goes on from the last path
        leaf[opens[stack[-1]]] = False

    counts, least = np.zeros(len(names), np.int64), np.full(len(names), np.iinfo(np.int64).max)
    counts[ends], least[ends] = members, first
    total = np.concatenate([[0], np.cumsum(counts)])
    n_convs = total[high] - total[low]
    saved = np.concatenate([[0], np.cumsum((n_convs - ~on_left) * np.array(tokens, np.int64))])
    conv = range_least(least, low, high)
    own_child = ~on_left
    own_child[0] = False
    shared_node = on_left | on_right
    return {
        "name": names, "parent": [names[p] if p >= 0 else None for p in parent], "depth": depths, "conv_id": conv, "parent_conv_id": np.where(up >= 0, conv[up], -1), "n_convs": n_convs,
        "n_children": np.bincount(up[own_child], minlength=len(names)), "n_leaves": tree.leaves(opens, closes, leaf), "saved_tokens": saved[high] - saved[low], "shared": shared_node, "shared_parent": (up >= 0) & shared_node[up],
    }


NODE = "name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, shared boolean, shared_parent boolean"


def turn_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path) of each conversation: its turns in order (a null turn first), each as a digest of role and text and its words.

    Words are what stands between ASCII white space; a null role or text counts as empty; rows without a conv_id are left
    out; turns with one number come in the order of their digests. Other columns aren't read, an empty table gives none.
    Texts aren't shuffled. A conversation's path is one row of some 60 bytes a turn.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("at"), digest.alias("turn"), size.alias("words")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["turn"].alias("turn"), t["words"].alias("words"))).cast(PATH).alias("path"))


def end_names(paths: DataFrame) -> DataFrame:
    """paths (conv_id, path) with `end`, the name of the node that the path ends at."""
    step = lambda name, t: F.unhex(F.substring(F.sha2(F.concat(name, t["turn"]), 256), 1, 32))
    return paths.select("conv_id", "path", F.aggregate("path", F.lit(ROOT), step).alias("end"))


def list_digests(ended: DataFrame) -> DataFrame:
    """(name, ends_sha256) of each node that conversations end at: of their ids in ascending order, joined by commas.

    Ids are put together in pieces by ranges of (node, id), so that a node of very many is no single task's; the pieces of
    a node are then hashed one after the other as they stream by.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if names[i] != names[i - 1]), len(ids)]
            rows = [(names[i], ids[i], ",".join(map(str, ids[i : min(i + PIECE, high)]))) for low, high in zip(cuts, cuts[1:], strict=False) for i in range(low, high, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["name", "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = name, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(out)
            out = []
        if state:
            yield made([(now, state.hexdigest())])

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.string()))], ["name", "ends_sha256"])

    ordered = ended.select(F.col("end").alias("name"), "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    texts = ordered.mapInArrow(pieces, "name binary, low long, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "low").mapInArrow(hashed, "name binary, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """(name, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    A node is a distinct sequence of the first turns of paths (conv_id, path as turn_paths gives it), the root the empty one.
    conv_id: the least member, a member being a conversation that begins with the node's turns; n_leaves: nodes without
    children in its subtree; saved_tokens: the words of each node of the subtree times its members but one; ends_sha256: of
    the ids of those that end there. Conversations without turns are members of the root; no conversations give no nodes.
    conv_id should be unique.

    Equal paths become one, paths are sorted and dealt to shards by ranges, and each shard writes its part of the trie in
    balanced parentheses. The path before and behind a shard are all that it knows of its neighbours; nodes on such a path
    lie in several shards, and only these are merged, by sums. So a turn that very many conversations begin with is dealt to
    many shards, and no shard holds more than about SHARD turns.
    """
    ended = cut(end_names(paths))
    distinct = cut(ended.groupBy("end").agg(F.count("*").alias("members"), F.min("conv_id").alias("first"), F.first("path").alias("path")))
    shards = max(1, -(-int(distinct.agg(F.sum(F.size("path") + 1)).first()[0] or 0) // SHARD))
    ranged = cut(distinct.repartitionByRange(shards, "path").withColumn("part", F.spark_partition_id()).select("part", "members", "first", "path"))
    edges = cut(ranged.groupBy("part").agg(F.min("path").alias("head"), F.max("path").alias("tail")))
    parts = sorted(r["part"] for r in edges.select("part").collect())  # as many as there are shards
    near = paths.sparkSession.createDataFrame(list(zip(parts, parts[1:], strict=False)), "low int, high int")
    none = [F.lit(None).cast("long").alias(c) for c in ("members", "first")]
    outer = edges.withColumnRenamed("part", "low").join(F.broadcast(near), "low").select(F.col("high").alias("part"), F.lit(0).alias("kind"), *none, F.col("tail").alias("path"))
    outer = outer.unionByName(edges.withColumnRenamed("part", "high").join(F.broadcast(near), "high").select(F.col("low").alias("part"), F.lit(2).alias("kind"), *none, F.col("head").alias("path")))
    rows = ranged.withColumn("kind", F.lit(1)).unionByName(outer).select("part", "kind", "members", "first", "path")
    rows = rows.repartition(shards, "part").sortWithinPartitions("part", "kind", "path")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            paths = batch.column(4)
            at, turns, sizes = paths.offsets.to_pylist(), paths.values.field(0).to_pylist(), paths.values.field(1).to_pylist()
            for i, (part, kind, members, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if part != now:
                    if held:
                        yield nodes(held)
                    now, held = part, []
                held.append((kind, members, first, turns[at[i] : at[i + 1]], sizes[at[i] : at[i + 1]]))
        if held:
            yield nodes(held)

    def nodes(held: list[tuple]) -> pa.RecordBatch:
        own = [r for r in held if r[0] == 1]
        before, after = (next((r[3] for r in held if r[0] == kind), None) for kind in (0, 2))
        found = shard_nodes([r[3] for r in own], [r[4] for r in own], [r[1] for r in own], [r[2] for r in own], before, after)
        kinds = {"name": pa.binary(), "parent": pa.binary(), "shared": pa.bool_(), "shared_parent": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()], list(found))

    local = cut(rows.mapInArrow(solve, NODE))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spines = cut(local.where("shared").groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), *sums, F.max("shared_parent").alias("shared_parent")))
    whole = local.where("not shared").drop("shared").unionByName(spines)
    parents = small_side(spines.select(F.col("name").alias("parent"), F.col("conv_id").alias("merged")))
    inner = whole.where("not shared_parent").withColumn("merged", F.lit(None).cast("long")).unionByName(whole.where("shared_parent").join(parents, "parent"))
    above = F.when(F.col("depth") > 0, F.coalesce("merged", "parent_conv_id"))
    named = inner.select("name", "conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    return named.join(list_digests(ended), "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))
