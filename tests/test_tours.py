"""Euler tours, cycle checks and folder moves against plain versions, on trees of every shape."""

import random

import pytest
from pyspark.sql import functions as F

from leafgraph.operators import hierarchy, tours

FOLDERS = "id long, name string, parent_id long, sort_order int"


def forest(seed, n):
    """Folders in trees, chains, circles with tails, and under missing parents."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = rng.choice([None, rng.randrange(n), max(0, i - 1), rng.randrange(max(1, i)), 10_000]) if i else None
        rows.append((i, rng.choice("abc"), parent, rng.randrange(3)))
    rng.shuffle(rows)
    return rows


def listed(rows, files, collapsed=()):
    """The tree from top to bottom, by recursion."""
    out = []

    def walk(parent, depth):
        for i, name, _, _ in sorted((r for r in rows if r[2] == parent), key=lambda r: (r[3], r[1], r[0])):
            out.append((0, i, name, depth))
            if i not in collapsed:
                walk(i, depth + 1)
        out.extend((1, i, title, depth) for i, title, folder, order in sorted((f for f in files if f[2] == parent), key=lambda f: (f[3], f[1], f[0])))

    walk(None, 0)
    return out


def frames(spark, rows, files):
    return spark.createDataFrame(rows, FOLDERS), spark.createDataFrame(files, "id long, title string, folder_id long, sort_order int")


@pytest.mark.parametrize("part", [3, 50, 1_000_000])
def test_listings_equal_a_recursive_version(spark, monkeypatch, part):
    monkeypatch.setattr(tours, "PART", part)
    rows = forest(part, 60)
    rng = random.Random(part)
    files = [(i, rng.choice("xy"), rng.choice([None, rng.randrange(60), 10_000]), rng.randrange(2)) for i in range(40)]
    folders, own = frames(spark, rows, files)
    assert [tuple(r) for r in hierarchy.flatten_tree(folders, own).collect()] == listed(rows, files)
    shut = [1, 5, 9, 20, 9]
    found = hierarchy.flatten_tree(folders, own, spark.createDataFrame([(i,) for i in shut], "id long"))
    assert [tuple(r) for r in found.collect()] == listed(rows, files, shut)
    paths = {r["id"]: (r["depth"], len(r["breadcrumb"])) for r in hierarchy.folder_paths(folders).collect()}
    assert paths == {i: (depth, depth + 1) for kind, i, _, depth in listed(rows, []) if not kind}


def test_no_folders(spark):
    folders, files = frames(spark, [], [(1, "t", None, 1), (2, "u", 7, 1)])
    assert [tuple(r) for r in hierarchy.flatten_tree(folders, files).collect()] == [(1, 1, "t", 0)]
    assert hierarchy.folder_paths(folders).isEmpty()
    asked = hierarchy.creates_cycle(folders, spark.createDataFrame([(1, 1), (1, 2), (1, None)], "id long, new_parent long"))
    assert sorted((tuple(r) for r in asked.collect()), key=repr) == [(1, 1, True), (1, 2, False), (1, None, False)]


@pytest.mark.parametrize("walk", [3, 1_000])
def test_cycle_checks_equal_walks(spark, monkeypatch, walk):
    monkeypatch.setattr(hierarchy, "WALK", walk)
    rows = forest(walk, 50) + [(100 + i, "c", 100 + (i + 1) % 7, 1) for i in range(7)] + [(200 + i, "t", 199 + i if i else 103, 1) for i in range(6)] + [(300, "s", 300, 1)]
    parent = {r[0]: r[2] for r in rows}

    def above(own, at):
        for _ in range(walk):
            if at not in parent or at == own:
                return at in parent
            at = parent[at]
        return False

    moves = [(a, b) for a in [*parent, 10_000] for b in [*parent, 10_000] if (a * 7 + b) % 3 == 0]
    found = hierarchy.creates_cycle(spark.createDataFrame(rows, FOLDERS), spark.createDataFrame(moves, "id long, new_parent long"))
    assert {(r["id"], r["new_parent"]): r["creates_cycle"] for r in found.collect()} == {(a, b): a == b or above(a, b) for a, b in moves}


def test_a_chain_of_a_hundred_thousand_folders(spark):
    n = 100_000
    folders = spark.range(n).selectExpr("id", "'f' as name", "nullif(id - 1, -1) as parent_id", "1 as sort_order")
    place = tours.positions(folders)
    assert place.where("first = id + 1 and last = 100000 and depth = id").count() == n


def test_many_interleaved_moves_equal_single_requests(spark):
    rng = random.Random(8)
    n = 3_000
    rows = [(i, "f", rng.randrange(i) if i > 5 else None, 1) for i in range(n)]
    moves = [(s, rng.randrange(n), rng.randrange(n) if rng.random() < 0.9 else None) for s in range(40_000)]
    parent, refused = {r[0]: r[2] for r in rows}, set()
    for s, own, to in moves:
        at, steps, bad = to, 0, False
        while at is not None and steps < 1_000:
            if at == own:
                bad = True
                break
            at, steps = parent[at], steps + 1
        if bad:
            refused.add(s)
        else:
            parent[own] = to
    patches = spark.createDataFrame([(s, own, None, to, to is None, None) for s, own, to in moves], "seq long, id long, name string, parent_id long, move_to_root boolean, sort_order int")
    after, bad = hierarchy.apply_folder_patches(spark.createDataFrame(rows, FOLDERS), patches)
    assert {r["id"]: r["parent_id"] for r in after.collect()} == parent and {r["seq"] for r in bad.collect()} == refused


def test_moves_of_small_components_are_decided_together(spark, monkeypatch):
    calls, decide = [], hierarchy._decide
    monkeypatch.setattr(hierarchy, "MOVES", 5)
    monkeypatch.setattr(hierarchy, "_decide", lambda *args: calls.append(1) or decide(*args))
    folders = spark.createDataFrame([(i, "f", None, 1) for i in range(40)], FOLDERS)
    moves = [(s, i, (i ^ 1), False) for s, i in enumerate([*range(40), *range(39, -1, -1)])]  # each pair under one another: the second is refused
    patches = spark.createDataFrame(moves, "seq long, id long, parent_id long, move_to_root boolean").selectExpr("seq", "id", "string(null) as name", "parent_id", "move_to_root", "int(null) as sort_order")
    after, bad = hierarchy.apply_folder_patches(folders, patches)
    assert {r["id"]: r["parent_id"] for r in after.collect()} == {i: i + 1 if i % 2 == 0 else None for i in range(40)} and bad.count() == 40
    assert len(calls) == 1


def test_a_task_ranks_one_part_of_a_list(spark, monkeypatch):
    most, cut = [], tours.cut
    monkeypatch.setattr(tours, "PART", 50)
    monkeypatch.setattr(tours, "cut", lambda df: most.append(df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]) or cut(df))
    events = spark.range(2_000).selectExpr("id as e", "if(id < 1999, id + 1, -1) as next", "1L as w")
    assert tours.list_sums(events, 2_000, ["w"]).where("w = 2000 - e").count() == 2_000
    assert most[0] == 50


def test_a_long_chain_in_any_order_takes_few_rounds(spark, monkeypatch):
    from leafgraph.operators import components

    calls, shape = [], components._shape
    monkeypatch.setattr(components, "FOREST", 500)
    monkeypatch.setattr(components, "_shape", lambda df: calls.append(1) or shape(df))
    edges = spark.range(3_000).selectExpr("id as from_id", "id + 1 as to_id").orderBy("from_id").selectExpr("from_id", "to_id").repartition(7)
    found = components.connected_components(edges, contract=True)
    assert found.count() == found.where("component = 0").count() == 3_001
    assert len(calls) == 1
