"""Layouts of all graphs: levels, order in rows, coordinates, and the geometry drawn from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions.texts import number_text
from leafgraph.operators.circles import circle_levels, last_levels
from leafgraph.session import cut, release, small_side

#: Gaps of the grid, height of a node, dip of a sibling's curve, height of a layer and gap of a ring (fixed values).
COLUMN_GAP, ROW_GAP, NODE_HEIGHT, DIP, LAYER, RING_GAP, RING_LEAST = 170, 110, 38, 38, 95, 62, 90
#: Sweeps over the rows; passes that are held while a period is looked for.
SWEEPS, KEPT = 4, 512
#: References from which on a graph's levels are found by joins and not in one task.
LARGE = 5_000_000
#: Nodes of a range that a task contracts by itself.
HELD = 1_000_000


def reference_levels(nodes: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(graph_id, file_id, level): the longest reference path from a node without an incoming reference.

    Graphs of up to `large` references are solved one in a task, cycles too: their levels then depend on the order of the
    edges (by from and to, or by a column seq) and on the bound of the passes, as those of graph_layout do. Larger graphs are solved
    together by joins, by contraction (`contracted_levels`), which raises RuntimeError where such a graph has a cycle.
    """
    refs = edges.where("kind = 'reference' and graph_id is not null and from_id is not null and to_id is not null")
    nodes = nodes.where("graph_id is not null and file_id is not null").select("graph_id", "file_id").distinct()
    order = F.col("seq").cast("long") if "seq" in edges.columns else F.lit(0).cast("long")
    refs = cut(refs.select("graph_id", order.alias("seq"), "from_id", "to_id"))
    big = cut(refs.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("graph_id"))
    if big.isEmpty():
        return _levels_in_tasks(nodes, refs)
    big = small_side(big)
    apart, together = ([df.join(big, "graph_id", how) for df in (nodes, refs)] for how in ("left_anti", "left_semi"))
    return _levels_in_tasks(*apart).unionByName(contracted_levels(*together))


def _levels_in_tasks(nodes: DataFrame, refs: DataFrame, kind: str = "1") -> DataFrame:
    """reference_levels of graphs that fit a task each; kind: 1 for references, 2 for siblings."""
    none = F.lit(0).cast("long")
    rows = nodes.select("graph_id", F.lit(0).alias("kind"), none.alias("seq"), F.col("file_id").alias("a"), none.alias("b"))
    rows = rows.unionByName(refs.select("graph_id", F.expr(kind).alias("kind"), "seq", F.col("from_id").alias("a"), F.col("to_id").alias("b")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for graphs in by_graph(batches):
            for graph_id, kinds, a, b in graphs:
                ids, links, siblings = graph_arrays(kinds, a, b)
                level = bounded_levels(ids, links, siblings)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), graph_id, np.int64)), pa.array(ids), pa.array(level)], ["graph_id", "file_id", "level"])

    rows = rows.repartition("graph_id").sortWithinPartitions("graph_id", "kind", "seq", "a", "b").drop("seq")
    return rows.mapInArrow(solve, "graph_id long, file_id long, level long")


def contracted_levels(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """reference_levels of graphs of any size without cycles, by joins.

    A node without an incoming reference hangs from its graph's root at distance 0. A node whose references all come from
    one node hangs from that one, at the length of the longest. What hangs from what is a forest; ranges of nodes, then pointer
    doubling find for each node the top of its tree and how far below it lies. Then
    references leave from the tops, parallel ones become their longest, and the same is done again until all hangs from
    roots. So chains, trees, and what branches and comes together again between two nodes are contracted at once, however
    long; a round takes at least what peeling off a level would. Levels are put together backwards at the end.
    """
    root = F.lit(None).cast("long")
    inside = cut(nodes.select("graph_id", F.col("file_id").alias("to_id")))
    ends = refs.join(inside, ["graph_id", "to_id"], "left_semi").join(inside.withColumnRenamed("to_id", "from_id"), ["graph_id", "from_id"], "left_semi")
    edges = ends.groupBy("graph_id", "from_id", "to_id").agg(F.lit(1).cast("long").alias("w"))
    sources = inside.join(ends.select("graph_id", "to_id"), ["graph_id", "to_id"], "left_anti").select("graph_id", root.alias("from_id"), "to_id", F.lit(0).cast("long").alias("w"))
    edges, hung = cut(edges.unionByName(sources)), []
    while True:
        # A null source is the root. Those with one source only hang from it; `up` null: from the root.
        one = edges.groupBy("graph_id", "to_id").agg(F.min("from_id").alias("low"), F.max("from_id").alias("high"), F.count("from_id").alias("named"), F.count("*").alias("n"), F.max("w").alias("w"))
        alone = (F.col("named") == 0) | ((F.col("low") == F.col("high")) & (F.col("named") == F.col("n")))
        single = cut(one.where(alone).select("graph_id", F.col("to_id").alias("id"), F.col("low").alias("up"), "w"))
        if single.isEmpty():
            if edges.isEmpty():
                break
            raise RuntimeError("a cycle of references")
        tops = _tops(single)
        hung.append(tops)
        rest = edges.join(tops.select("graph_id", F.col("id").alias("to_id")), ["graph_id", "to_id"], "left_anti")
        over = tops.select("graph_id", F.col("id").alias("from_id"), F.col("top").alias("__top"), F.col("w").alias("__more"), F.lit(True).alias("__hung"))
        moved = rest.join(over, ["graph_id", "from_id"], "left")
        source = F.when(F.col("__hung"), F.col("__top")).otherwise(F.col("from_id"))
        before, edges = edges, cut(moved.select("graph_id", source.alias("from_id"), "to_id", (F.col("w") + F.coalesce("__more", F.lit(0))).alias("w")).groupBy("graph_id", "from_id", "to_id").agg(F.max("w").alias("w")))
        release(before, single)
    done = None
    for tops in reversed(hung):  # the last ones hang from roots, earlier ones also from those that came later
        if done is None:
            done = tops.select("graph_id", "id", F.col("w").alias("level"))
            continue
        above = done.select("graph_id", F.col("id").alias("top"), F.col("level").alias("__level"))
        done = cut(done.unionByName(tops.join(above, ["graph_id", "top"], "left").select("graph_id", "id", (F.col("w") + F.coalesce("__level", F.lit(0))).alias("level"))))
    if done is None:
        return inside.select("graph_id", F.col("to_id").alias("file_id"), F.lit(0).cast("long").alias("level"))
    return done.select("graph_id", F.col("id").alias("file_id"), "level")


def _tops(single: DataFrame) -> DataFrame:
    """(graph_id, id, top, w) of (graph_id, id, up, w): the first node upwards that itself hangs from nothing (null: the root), and the distance to it.

    Ranges of nodes are first contracted in a task each; pointer doubling by joins is left to nodes that other ranges lead to.
    """
    near = cut(_within(single))
    now = cut(near.join(near.select("graph_id", F.col("top").alias("id")).distinct(), ["graph_id", "id"], "left_semi"))
    most = max(1, now.count()).bit_length() + 1
    for _ in range(most):
        moved = cut(_further(now, now))
        release(now)
        now = moved
        if moved.where("on").isEmpty():
            out = cut(_further(near, now.drop("on")).drop("on"))
            release(near, now)
            return out
    raise RuntimeError("a cycle of references")


def _further(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """rows (graph_id, id, top, w) led on to the tops of their tops, with `on`: whether there was one."""
    further = tops.select("graph_id", F.col("id").alias("top"), F.col("top").alias("__next"), F.col("w").alias("__more"), F.lit(True).alias("__on"))
    step = rows.join(further, ["graph_id", "top"], "left")
    return step.select("graph_id", "id", F.when(F.col("__on"), F.col("__next")).otherwise(F.col("top")).alias("top"), (F.col("w") + F.coalesce("__more", F.lit(0))).alias("w"), F.coalesce("__on", F.lit(False)).alias("on"))


def _within(single: DataFrame) -> DataFrame:
    """(graph_id, id, top, w) of (graph_id, id, up, w), led upwards as far as a range of HELD nodes goes. A circle in a range stays one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        graph, own, up, w = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
        none = up.is_null().to_numpy(zero_copy_only=False)
        graph, own, to, w = (c.to_numpy(zero_copy_only=False).copy() for c in (graph, own, up.fill_null(0), w))
        names, rank = np.unique(np.concatenate([own, to]), return_inverse=True)
        key = np.unique(graph, return_inverse=True)[1] * len(names)
        key, wanted = key + rank[: len(own)], key + rank[len(own) :]
        order = np.argsort(key, kind="stable")
        at = order[np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)]
        at = np.where((key[at] == wanted) & ~none, at, -1)
        for _ in range(len(own).bit_length() + 1):
            on = np.flatnonzero(at >= 0)
            if not len(on):
                break
            then = at[on]
            w[on], to[on], none[on], at[on] = w[on] + w[then], to[then], none[then], at[then]
        for low in range(0, len(own), 100_000):
            part = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(graph[part]), pa.array(own[part]), pa.array(to[part], mask=none[part]), pa.array(w[part])], ["graph_id", "id", "top", "w"])

    rows = single.select(*[F.col(c).cast("long").alias(c) for c in ("graph_id", "id", "up", "w")])
    return rows.repartitionByRange(max(1, -(-single.count() // HELD)), "graph_id", "id").mapInArrow(run, "graph_id long, id long, top long, w long")


def waves(reads: np.ndarray, writes: np.ndarray, count: int) -> list[np.ndarray]:
    """Steps in stored order, dealt to waves that may each be taken at once: step i reads the nodes reads[i] and raises the nodes writes[i].

    A step comes after those that raised what it reads or raises, and not before those that read what it raises.
    """
    raised, read = [0] * count, [0] * count  # the first wave that sees a node's last value, the last wave that read it
    at = []
    for r, w in zip(reads.tolist(), writes.tolist(), strict=True):
        wave = max(*(raised[i] for i in r), *(max(raised[i], read[i]) for i in w))
        for i in r:
            read[i] = max(read[i], wave)
        for i in w:
            raised[i] = wave + 1
        at.append(wave)
    order = np.argsort(np.array(at, np.int64), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.array(at, np.int64)[order])) + 1) if len(order) else []


class Sweep:
    """One pass over all edges in stored order, a wave at a time; what a pass raises counts in the same pass already."""

    def __init__(self, count: int, refs: np.ndarray, siblings: np.ndarray) -> None:
        self.refs, self.siblings = refs, siblings
        self.down = [(refs[w, 0], refs[w, 1]) for w in waves(refs[:, :1], refs[:, 1:], count)]
        self.level_out = [(siblings[w, 0], siblings[w, 1]) for w in waves(siblings[:, :0], siblings, count)]

    def push(self, level: np.ndarray) -> None:
        for a, b in self.down:
            level[b] = np.maximum(level[b], level[a] + 1)

    def share(self, level: np.ndarray) -> None:
        for a, b in self.level_out:
            level[a] = level[b] = np.maximum(level[a], level[b])

    def never_slows(self, rise: np.ndarray, siblings: bool) -> bool:
        """Whether no edge leads from a node that rises faster to one that rises slower."""
        down = (rise[self.refs[:, 1]] >= rise[self.refs[:, 0]]).all()
        return bool(down and (not siblings or (rise[self.siblings[:, 0]] == rise[self.siblings[:, 1]]).all()))


def repeat(step: Callable[[np.ndarray], None], level: np.ndarray, most: int, lasts: Callable[[np.ndarray], bool]) -> np.ndarray:
    """level after `most` steps, or fewer if a step changes nothing.

    Steps take maxima of sums, so that what they add comes to repeat with some period, on cycles of references. Once two
    periods in a row have added the same, pass by pass, and no edge leads to a node that rises slower (`lasts`), each
    later period adds the same too: a node's level then comes from one that rises as fast as it does, for if one that
    rises slower had decided it, the second period would have added less. So the rest is multiplied, not walked through.
    """
    seen: dict[bytes, list[int]] = {}
    added: list[bytes] = []
    kept = [level.copy()]
    for done in range(1, most + 1):
        step(level)
        rise = level - kept[-1]
        if not rise.any():
            return level
        kept.append(level.copy())
        digest = blake2b(rise.tobytes(), digest_size=16).digest()
        added.append(digest)
        for before in reversed(seen.get(digest, [])[-8:]):
            period = done - before
            if 2 * period <= done and added[-period:] == added[-2 * period : -period]:
                whole = level - kept[-1 - period]
                if lasts(whole):
                    level += (most - done) // period * whole
                    for _ in range((most - done) % period):
                        step(level)
                    return level
        seen.setdefault(digest, []).append(done)
        if len(kept) > KEPT:  # periods are short; only the newest passes are held
            kept = kept[-KEPT // 2 :]
            added = added[-KEPT // 2 :]
            seen = {d: [i for i in at if i > done - KEPT // 2] for d, at in seen.items() if at[-1] > done - KEPT // 2}
    return level


def sibling_groups(count: int, siblings: np.ndarray) -> np.ndarray:
    """For each node the number of its group: nodes that chains of siblings join, numbered from 0."""
    root = list(range(count))
    for a, b in siblings.tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    least = np.array(root, np.int64)
    while (least[least] != least).any():
        least = least[least]
    return np.unique(least, return_inverse=True)[1]


class Arrows:
    """For each node the nodes that edges (pairs of positions) lead to."""

    def __init__(self, count: int, edges: np.ndarray) -> None:
        order = np.argsort(edges[:, 0], kind="stable")
        self.to = edges[order, 1].tolist()
        self.first = np.concatenate([[0], np.cumsum(np.bincount(edges[:, 0], minlength=count))]).tolist()

    def reached(self, start: list[int]) -> set[int]:
        found, todo = set(start), list(start)
        while todo:
            node = todo.pop()
            for other in self.to[self.first[node] : self.first[node + 1]]:
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return found


def longest_paths(count: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels, free): the longest path to each node, in topological order; nodes on a cycle or below one are not free."""
    arrows, missing, level = Arrows(count, edges), np.bincount(edges[:, 1], minlength=count).tolist(), [0] * count
    todo = [i for i, n in enumerate(missing) if not n]
    free = np.zeros(count, bool)
    to, first = arrows.to, arrows.first
    while todo:
        node = todo.pop()
        free[node], below = True, level[node] + 1
        for other in to[first[node] : first[node + 1]]:
            if level[other] < below:
                level[other] = below
            missing[other] -= 1
            if not missing[other]:
                todo.append(other)
    return np.array(level, np.int64), free


def bounded_levels(ids: np.ndarray, refs: np.ndarray, siblings: np.ndarray) -> np.ndarray:
    """Levels of one graph, exactly, cycles and siblings too: edges are pairs of positions in ids, in stored order.

    Levels are what passes over the edges lead to, where what a pass raises counts in the same pass already. Siblings share
    a level, so groups of siblings are taken as one; then a group that is neither on a cycle nor below one has the length
    of the longest path to it, for no path has more steps than there are passes. Only what lies on cycles or below them
    depends on the order of the edges and on the number of passes, and is passed over, with what leads there.
    """
    group = sibling_groups(len(ids), siblings) if len(siblings) else np.arange(len(ids))
    edges, count = group[refs], int(group.max()) + 1 if len(ids) else 0
    level, free = longest_paths(count, edges)
    if free.all():
        return level[group]
    tied = ~free[group]
    if len(siblings) and tied[siblings[:, 0]].any():
        above = np.flatnonzero(~free)
    else:
        # Without siblings a cycle lifts what is below it over all paths that don't come from it: only what leads to cycles counts.
        around = edges[~free[edges[:, 0]] & ~free[edges[:, 1]]]
        _, below = longest_paths(count, around[:, ::-1])  # from which no cycle can be reached
        above = np.flatnonzero(~free & ~below)
    taken = np.zeros(count, bool)
    taken[list(Arrows(count, edges[:, ::-1]).reached(above.tolist()))] = True
    taken |= ~free
    own = np.flatnonzero(taken[group])
    at = np.full(len(ids), -1)
    at[own] = np.arange(len(own))
    inside = [at[e[taken[group[e[:, 0]]] & taken[group[e[:, 1]]]]] for e in (refs, siblings)]
    out = level[group]
    out[own] = passes(len(own), *inside, len(ids) + 2)
    return out


def passes(count: int, refs: np.ndarray, siblings: np.ndarray, most: int) -> np.ndarray:
    """Levels after `most` passes at most over references alone, then as many over siblings and references."""
    sweep = Sweep(count, refs, siblings)
    level = repeat(sweep.push, np.zeros(count, np.int64), most, lambda rise: sweep.never_slows(rise, False))

    def both(level: np.ndarray) -> None:
        sweep.share(level)
        sweep.push(level)

    return repeat(both, level, most, lambda rise: sweep.never_slows(rise, True))


def row_order(ids: np.ndarray, level: np.ndarray, refs: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Each node's place in its row: by id at first, then by the mean place of its reference neighbours, row by row. ids ascend."""
    ends = np.concatenate([refs, refs[:, ::-1]])
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    degree = np.bincount(ends[:, 0], minlength=len(ids))
    first = np.concatenate([[0], np.cumsum(degree)])
    order = np.argsort(level, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(level[order])) + 1, [len(order)]])
    rows = [order[low:high] for low, high in zip(starts[:-1], starts[1:], strict=True) if high - low > 1]  # the only node of a row stays where it is
    place = np.zeros(len(ids), np.int64)
    for row in rows:
        place[row] = np.arange(len(row))
    near = [np.concatenate([ends[first[i] : first[i + 1], 1] for i in row]) for row in rows]
    for _ in range(sweeps):
        for row, others in zip(rows, near, strict=True):
            means = place[row].astype(np.float64)
            some = degree[row] > 0
            if some.any():
                starts = np.cumsum(degree[row][some]) - degree[row][some]
                means[some] = np.add.reduceat(place[others], starts) / degree[row][some]
            place[row[np.lexsort((row, means))]] = np.arange(len(row))
    return place


def graph_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, file_id, level, row_index, x, y) of nodes (graph_id, file_id) and edges (graph_id, from_id, to_id, kind).

    Edges with an end outside the graph's nodes are ignored; the rest are taken by from, to, kind (or by a column seq).
    Levels and rows of a graph of any size are found in one task, since each step of them depends on the one before:
    it needs some 300 bytes for each node and edge. Graphs are spread over tasks. Where levels of references alone are
    wanted, reference_levels finds those of larger graphs by joins.
    """
    nodes = nodes.where("graph_id is not null and file_id is not null").select("graph_id", "file_id").distinct()
    order = F.col("seq") if "seq" in edges.columns else F.lit(0)
    kind = F.when(F.col("kind") == "reference", 1).when(F.col("kind") == "sibling", 2)
    rows = nodes.select("graph_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.col("file_id").alias("a"), F.lit(0).cast("long").alias("b"))
    links = edges.where(kind.isNotNull() & F.col("graph_id").isNotNull() & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    rows = rows.unionByName(links.select("graph_id", kind.alias("kind"), order.cast("long").alias("seq"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    rows = rows.repartition("graph_id").sortWithinPartitions("graph_id", "kind", "seq", "a", "b").drop("seq")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for graphs in by_graph(batches):
            placed = [(graph_id, *place_graph(kinds, a, b)) for graph_id, kinds, a, b in graphs]
            columns = [np.concatenate([np.full(len(x[1]), x[0], np.int64) for x in placed]), *(np.concatenate([x[i] for x in placed]) for i in (1, 2, 3))] if placed else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["graph_id", "file_id", "level", "row_index"])

    return grid_position(rows.mapInArrow(solve, "graph_id long, file_id long, level long, row_index long"))


def graph_levels(nodes: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(graph_id, file_id, level) as graph_layout gives it, without rows and places.

    Graphs of more than `large` edges are solved by joins if they have no siblings and no node has more than one incoming reference:
    trees, and circles with what hangs below them; also those with more references, if the last one to each node decides its level
    (`last_levels`: rings with shorter ways across). All others are solved one in a task, as in graph_layout.
    """
    nodes = cut(nodes.where("graph_id is not null and file_id is not null").select("graph_id", "file_id").distinct())
    order = F.col("seq").cast("long") if "seq" in edges.columns else F.lit(0).cast("long")
    kind = F.when(F.col("kind") == "reference", 1).when(F.col("kind") == "sibling", 2)
    links = edges.select("graph_id", kind.alias("kind"), order.alias("seq"), "from_id", "to_id")
    links = links.where("kind is not null and graph_id is not null and from_id is not null and to_id is not null")
    for c in ("from_id", "to_id"):
        links = links.join(nodes.withColumnRenamed("file_id", c), ["graph_id", c], "left_semi")
    links = cut(links.select("graph_id", "kind", "seq", "from_id", "to_id"))
    sizes = links.groupBy("graph_id", "to_id").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    plain = sizes.groupBy("graph_id").agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.max("kind").alias("kind"))
    plain = cut(plain.where((F.col("all") > large) & (F.col("kind") == 1)).select("graph_id", "n"))
    several, out = cut(plain.where("n > 1").select("graph_id")), None
    if not several.isEmpty():
        found, out = last_levels(*(df.join(small_side(several), "graph_id", "left_semi") for df in (nodes, links)))
        plain = cut(plain.join(small_side(out), "graph_id", "left_anti"))
    if plain.isEmpty():
        return _levels_in_tasks(nodes, links, "kind")
    apart = [df.join(small_side(plain), "graph_id", "left_anti") for df in (nodes, links)]
    levels = _levels_in_tasks(*apart, "kind")
    if out is not None:
        levels = levels.unionByName(found)
    single = cut(plain.where("n = 1").select("graph_id"))
    if single.isEmpty():
        return levels
    return levels.unionByName(circle_levels(*(df.join(small_side(single), "graph_id", "left_semi") for df in (nodes, links))))


def by_graph(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(graph_id, kinds, a, b) of each graph in rows (graph_id, kind, a, b) sorted by graph, as lists; a graph may span batches."""
    now, held = None, []
    whole = lambda: (now, *(np.concatenate([x[i] for x in held]) for i in range(3)))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, *columns = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(4))
        edges, done = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)], []
        for low, high in zip(edges, edges[1:], strict=False):
            if held and ids[low] != now:
                done.append(whole())
                held = []
            now = int(ids[low])
            held.append([c[low:high] for c in columns])
        yield done
    if held:
        yield [whole()]


def graph_arrays(kinds: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, references, siblings) of one graph's rows: nodes (kind 0), references (1) and siblings (2) in stored order; edges as pairs of positions in ids."""
    ids = np.sort(a[kinds == 0])
    if not len(ids):
        return ids, np.empty((0, 2), np.int64), np.empty((0, 2), np.int64)
    at = [np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (a, b)]
    inside = (ids[at[0]] == a) & (ids[at[1]] == b)
    refs, siblings = (np.stack([x[(kinds == k) & inside] for x in at], axis=1) for k in (1, 2))
    return ids, refs, siblings


def place_graph(kinds: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, levels, places in the rows) of one graph's rows."""
    ids, refs, siblings = graph_arrays(kinds, a, b)
    if len(refs) or len(siblings):
        level = bounded_levels(ids, refs, siblings)
        return ids, level, row_order(ids, level, refs)
    return ids, np.zeros(len(ids), np.int64), np.arange(len(ids))


def row_positions(levels: DataFrame) -> DataFrame:
    """levels (graph_id, file_id, level) with row_index by id and row_length."""
    row = Window.partitionBy("graph_id", "level")
    return levels.withColumn("row_index", (F.row_number().over(row.orderBy("file_id")) - 1).cast("long")).withColumn("row_length", F.count("*").over(row))


def grid_position(rows: DataFrame, column_gap: int = COLUMN_GAP, row_gap: int = ROW_GAP) -> DataFrame:
    """rows (graph_id, level, row_index, ...) with x and y: each row centred on 0, levels one below the other."""
    length = F.count("*").over(Window.partitionBy("graph_id", "level"))
    x = F.col("row_index") * F.lit(float(column_gap)) - (length - 1) * F.lit(column_gap / 2)
    return rows.select("graph_id", "file_id", "level", "row_index", x.alias("x"), (F.col("level") * F.lit(float(row_gap))).alias("y"))


def layout_bounds(layout: DataFrame) -> DataFrame:
    return layout.groupBy("graph_id").agg(*[getattr(F, f)(c).alias(f"{f}_{c}") for c in ("x", "y") for f in ("min", "max")])


def ring_position(layout: DataFrame, active: DataFrame) -> DataFrame:
    """(graph_id, file_id, x, y, z) around the active document (graph_id, active_id): each level a ring, the active one in the centre of its own."""
    own = layout.select("graph_id", F.col("file_id").alias("active_id"), F.col("level").alias("__focus"))
    j = layout.join(active.join(own, ["graph_id", "active_id"], "left"), "graph_id").withColumn("__focus", F.coalesce("__focus", F.lit(0)))
    j = j.withColumn("__centre", F.col("file_id") == F.col("active_id"))
    ring = Window.partitionBy("graph_id", "level", "__centre")
    n, i = F.count("*").over(ring), F.row_number().over(ring.orderBy("row_index")) - 1
    radius = F.when(n == 1, 80.0).otherwise(F.greatest(F.lit(float(RING_LEAST)), n * F.lit(RING_GAP / (2 * math.pi))))
    j = j.withColumn("__r", F.when(F.col("__centre"), 0.0).otherwise(radius)).withColumn("__a", i / n * F.lit(2 * math.pi))
    return j.select("graph_id", "file_id", (F.cos("__a") * F.col("__r")).alias("x"), ((F.col("__focus") - F.col("level")) * F.lit(float(LAYER))).alias("y"), (F.sin("__a") * F.col("__r")).alias("z"))


def edge_geometry(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """(graph_id, from_id, to_id, kind, x1, y1, x2, y2, path): the SVG path of each edge both of whose ends have a place."""
    a = layout.select("graph_id", F.col("file_id").alias("from_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = layout.select("graph_id", F.col("file_id").alias("to_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = edges.join(a, ["graph_id", "from_id"]).join(b, ["graph_id", "to_id"])
    half = NODE_HEIGHT / 2
    down = F.when(F.col("y2") < F.col("y1"), -half).otherwise(half)

    def text(*parts: str | Column) -> Column:
        return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else number_text(p) for p in parts])

    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    line = text("M", x1, y1 + down, "L", x2, y2 - down)
    curve = text("M", x1, y1 + half, "Q", (x1 + x2) / 2, y1 + half + DIP, x2, y2 + half)
    return j.select("graph_id", "from_id", "to_id", "kind", "x1", "y1", "x2", "y2", F.when(F.col("kind") == "reference", line).otherwise(curve).alias("path"))
