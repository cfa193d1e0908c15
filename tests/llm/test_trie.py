"""Conversation tries against plain versions."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from leafgraph.llm import queries, trie

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """The nodes' rows of {conv_id: [(role, text), ...]}."""
    nodes = defaultdict(list)
    for conv_id, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv_id)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(nodes[node]) - 1) * words + sum(saved[c] for c in children[node])
    rows = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(node))
        rows.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children[node]), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def listed(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def test_the_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert listed(queries.op13_conversations(spark, SF)) == brute(rebuilt(rows))


def random_turns(seed, convs, turns, kinds):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None, ""]), " ".join(["w"] * rng.randint(0, 3)) + rng.choice(kinds)) for c in range(convs) for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("shard", [1, 7, 100, 100_000])
def test_shards_of_any_size_give_the_same_trie(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    rows = random_turns(shard, 90, 5, ["", " x", "\ty \n z"]) + [(None, 0, "user", "no conversation"), (500, None, None, None), (500, 0, "user", "a"), (500, 1, "user", "b"), (500, 1, "user", "b")] + [(1000 + i, 0, "user", "same") for i in range(40)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, path string")
    assert listed(trie.prefix_trie(queries.rebuilt_conversations(turns))) == brute(rebuilt(rows))


def test_pieces_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(-5, 50)] + [(100, 0, "user", "same"), (100, 1, "user", "more " * 50_000)]
    paths = trie.turn_paths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plain = defaultdict(list)
    for c, _, role, text in rows:
        plain[c].append((role, text))
    assert listed(trie.prefix_trie(paths)) == brute(plain)


def test_no_conversations_give_no_nodes(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(queries.rebuilt_conversations(turns)).isEmpty()


def test_pairs_of_parentheses():
    rng = random.Random(5)
    for size in (0, 1, 63, 64, 65, 500, 5_000):
        bits, depth, opened = [1], 1, 0
        while opened < size or depth > 1:
            up = opened < size and (depth == 1 or rng.random() < 0.6)
            bits.append(int(up))
            depth, opened = depth + (1 if up else -1), opened + up
        bits.append(0)
        tree, stack, pairs = trie.BalancedParentheses(np.array(bits)), [], {}
        for i, bit in enumerate(bits):
            if bit:
                stack.append(i)
            else:
                pairs[stack.pop()] = i
        opens = tree.opens()
        assert tree.find_close(opens).tolist() == [pairs[i] for i in opens.tolist()]
        leaves = [sum(bits[j] and not bits[j + 1] for j in range(i, pairs[i])) for i in opens.tolist()[:50]]
        assert tree.leaves(opens, tree.find_close(opens)).tolist()[:50] == leaves
