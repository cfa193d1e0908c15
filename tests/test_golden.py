"""Cases worked by hand for what depends on order or state."""

from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgraph.functions import paths, texts
from leafgraph.operators import attachments, circles, colormaps, export, graphs, hierarchy, ingest, layout, patches, relations, text_inventory
from leafgraph.operators.components import connected_components
from leafgraph.operators.numbering import number_rows, number_within


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.mark.parametrize(
    ("f", "value", "wanted"),
    [
        (texts.slug, "Hello, World__9", "hello-world-9"), (texts.slug, "  ", "doc"), (texts.slug, None, "doc"), (texts.slug, "Über", "ber"),
        (paths.base_name, "docs\\Spec.MD", "spec.md"), (paths.base_name, "a/b/", ""), (paths.base_name, None, ""), (paths.path_title, "/a/b.c.md", "b.c"), (paths.path_title, "/a/.md", ""),
        (paths.canonical_path, "/a/./b//../c", "/a/c"), (paths.canonical_path, "/../x", "/x"), (paths.canonical_path, "/", "/"), (paths.path_ext, "/a.b/c", ""), (paths.path_ext, "c.", ""), (paths.path_ext, "c.tar.MD", ".MD"),
        (lambda c: texts.truncate_label(c, F.lit(7)), "x" * 18, "x" * 18), (lambda c: texts.truncate_label(c, F.lit(7)), "x" * 19, "x" * 17 + "…"), (lambda c: texts.truncate_label(c, F.lit(7)), "", "#7"),
        (texts.trim_ws, "  a b\t\n", "a b"), (lambda c: texts.escape_html(c, True), "<a&\"'>", "&lt;a&amp;&quot;&#39;&gt;"), (texts.is_external, "HTTPS://x", True), (texts.is_external, "docs/x", False),
    ],
)
def test_scalars(spark, f, value, wanted):
    assert one(spark, f, value) == wanted


def test_sizes_names_and_order(spark):
    assert [one(spark, texts.format_size, n, "long") for n in (1023, 1024, 1280, 1048576)] == ["1023 B", "1.0 KB", "1.3 KB", "1.0 MB"]
    assert one(spark, texts.bundle_name, datetime(2026, 6, 30, 18, 4), "timestamp") == "30-06-2026_18-04-UTC.zip"
    names = spark.createDataFrame([("B",), ("_",), ("a",)], "n string").orderBy(paths.fold_case(F.col("n")))
    assert [r[0] for r in names.collect()] == ["a", "B", "_"]


LAYOUTS = {
    "chain": ([1, 2, 3], "1R2 2R3", {1: 0, 2: 1, 3: 2}, [[1], [2], [3]]),
    "shortcut": ([1, 2, 3, 4], "1R2 1R3 2R4 1R4", {1: 0, 2: 1, 3: 1, 4: 2}, [[1], [2, 3], [4]]),
    "sibling push": ([1, 2, 3, 4], "1R2 2S3 3R4", {1: 0, 2: 1, 3: 1, 4: 2}, [[1], [2, 3], [4]]),
    "crossing": ([1, 2, 3, 4], "1R4 2R3", {1: 0, 2: 0, 3: 1, 4: 1}, [[2, 1], [3, 4]]),
    "cycle": ([1, 2], "1R2 2R1", {1: 16, 2: 15}, [[2], [1]]),
    "cycle, swapped": ([1, 2], "2R1 1R2", {1: 15, 2: 16}, [[1], [2]]),
    "self-loop": ([1], "1R1", {1: 6}, [[1]]),
    "sibling conflict": ([1, 2], "1R2 1S2", {1: 4, 2: 5}, [[1], [2]]),
    "lone": ([7], "", {7: 0}, [[7]]),
}


def test_layouts(spark):
    nodes = spark.createDataFrame([(g, n) for g, (ids, *_) in enumerate(LAYOUTS.values()) for n in ids], "graph_id long, file_id long")
    edges = [(g, int(e[0]), int(e[2]), {"R": "reference", "S": "sibling"}[e[1]], i) for g, (_, text, *_) in enumerate(LAYOUTS.values()) for i, e in enumerate(text.split())]
    found = layout.graph_layout(nodes, spark.createDataFrame(edges, "graph_id long, from_id long, to_id long, kind string, seq long")).collect()
    for g, (name, (_, _, levels, order)) in enumerate(LAYOUTS.items()):
        own = [r for r in found if r["graph_id"] == g]
        assert {r["file_id"]: r["level"] for r in own} == levels, name
        by_level = sorted({r["level"] for r in own})
        assert [[r["file_id"] for r in sorted((r for r in own if r["level"] == v), key=lambda r: r["row_index"])] for v in by_level] == order, name
    assert sorted(r["x"] for r in found if r["graph_id"] == 1 and r["level"] == 1) == [-85.0, 85.0]


def plain_layout(n, refs, siblings):
    """(levels, places in the rows) step by step, as the rules read."""
    level, most = [0] * n, n + 2

    def push():
        moved = False
        for a, b in refs:
            if level[b] <= level[a]:
                level[b], moved = level[a] + 1, True
        return moved

    rounds = 0
    while rounds < most and push():
        rounds += 1
    for _ in range(most):
        moved = False
        for a, b in siblings:
            if level[a] != level[b]:
                level[a] = level[b] = max(level[a], level[b])
                moved = True
        if not push() and not moved:
            break
    near, rows_of, place = [[] for _ in range(n)], {}, [0] * n
    for a, b in refs:
        near[a].append(b)
        near[b].append(a)
    for i in range(n):
        rows_of.setdefault(level[i], []).append(i)
    for row in rows_of.values():
        for k, i in enumerate(row):
            place[i] = k
    for _ in range(4):
        for value in sorted(rows_of):
            mean = {i: sum(place[x] for x in near[i]) / len(near[i]) if near[i] else place[i] for i in rows_of[value]}
            rows_of[value].sort(key=lambda i: (mean[i], i))
            for k, i in enumerate(rows_of[value]):
                place[i] = k
    return level, place


def test_layouts_equal_a_plain_version():
    rng = np.random.default_rng(1)
    for n in [*rng.integers(1, 60, 150).tolist(), 1500]:
        refs, siblings = rng.integers(0, n, (int(rng.integers(0, 2 * n + 1)), 2)), rng.integers(0, n, (int(rng.integers(0, n // 2 + 1)), 2))
        refs = refs if n % 3 else np.sort(refs, axis=1)[refs[:, 0] != refs[:, 1]]
        level = layout.bounded_levels(np.arange(n), refs, siblings)
        assert (level.tolist(), layout.row_order(np.arange(n), level, refs).tolist()) == plain_layout(n, refs.tolist(), siblings.tolist())


def test_large_graphs_with_cycles(spark):
    n = 30_000
    around = spark.range(n).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("from_id"), ((F.col("id") + 1) % n).alias("to_id"), F.lit("reference").alias("kind"))
    nodes = around.select("graph_id", F.col("from_id").alias("file_id"))
    found = layout.graph_layout(nodes, around)
    # Each of the 2 (n + 2) passes over a ring, in order, takes its first node n levels on, and the others after it.
    last = 2 * (n + 2) * n
    assert tuple(found.agg(F.min("level"), F.max("level"), F.count_distinct("level")).first()) == (last - n + 1, last, n)
    loop = spark.createDataFrame([(1, 1, 2, "reference"), (1, 2, 1, "reference")], "graph_id long, from_id long, to_id long, kind string")
    with pytest.raises(RuntimeError, match="cycle"):
        layout.reference_levels(loop.select("graph_id", F.col("from_id").alias("file_id")), loop, large=0).collect()
    assert {tuple(r) for r in layout.reference_levels(loop.select("graph_id", F.col("from_id").alias("file_id")), loop).collect()} == {(1, 1, 16), (1, 2, 15)}


def test_levels_of_a_long_chain_stored_backwards():
    n = 300_000
    refs = np.stack([np.arange(1, n), np.arange(n - 1)], axis=1)
    assert layout.bounded_levels(np.arange(n), refs, refs[:0]).tolist() == list(range(n - 1, -1, -1))


def test_levels_above_and_below_cycles():
    """What leads to cycles, what they lead to and what has nothing to do with them, with and without siblings there."""
    rng = np.random.default_rng(4)
    for _ in range(1500):
        n = int(rng.integers(2, 14))
        refs, siblings = rng.integers(0, n, (int(rng.integers(0, 2 * n)), 2)), rng.integers(0, n, (int(rng.integers(0, n)) * int(rng.integers(0, 2)), 2))
        refs = (refs, np.sort(refs, axis=1), np.sort(refs, axis=1)[:, ::-1])[int(rng.integers(0, 3))]
        assert layout.bounded_levels(np.arange(n), refs, siblings).tolist() == plain_layout(n, refs.tolist(), siblings.tolist())[0]


def test_levels_by_joins_equal_those_in_tasks(spark):
    rng = np.random.default_rng(9)
    edges = [(g, int(a), int(b), "reference") for g in range(6) for a, b in np.sort(rng.integers(0, 40, (12 * g, 2)), axis=1) if a != b]
    edges += [(7, i + 1, i, "reference") for i in range(300)] + [(7, 400, 5, "sibling"), (7, 9_999, 3, "reference"), (None, 1, 2, "reference")]
    nodes = [(g, i) for g in range(7) for i in range(40)] + [(7, i) for i in range(401)]
    nodes, edges = spark.createDataFrame(nodes, "graph_id long, file_id long"), spark.createDataFrame(edges, "graph_id long, from_id long, to_id long, kind string")
    want = sorted(map(tuple, layout.reference_levels(nodes, edges).collect()))
    assert sorted(map(tuple, layout.reference_levels(nodes, edges, large=0).collect())) == want
    assert sorted(map(tuple, layout.reference_levels(nodes, edges, large=60).collect())) == want
    assert max(r[2] for r in want) == 300


@pytest.mark.parametrize("held", [3, 40, 1_000_000])
def test_levels_around_circles_by_joins(spark, monkeypatch, held):
    """Trees and circles with trees below them, in any order, through ranges of any size; what has siblings or two references to a node is left to a task."""
    monkeypatch.setattr(circles, "HELD", held)
    rng = np.random.default_rng(held)
    nodes, edges, want = [], [], []
    for g in range(12):
        n = int(rng.integers(1, 70))
        up = (np.arange(n) - 1) % n if g % 4 == 0 else rng.permutation(n) if g % 4 == 1 else rng.integers(0, n, n)  # a ring, circles, circles with trees
        refs = [(int(a), b) for b, a in enumerate(up) if g % 4 < 3 or rng.integers(4)]
        refs += [(0, n - 1)] if g == 10 else []
        siblings = [(0, n - 1)] if g == 11 else []
        seq = rng.permutation(len(refs))
        stored = sorted(zip(seq.tolist(), refs, strict=True)) if g % 3 else sorted(zip([0] * len(refs), refs, strict=True))
        level = layout.bounded_levels(np.arange(n), np.array([r for _, r in stored], np.int64).reshape(-1, 2), np.array(siblings, np.int64).reshape(-1, 2))
        nodes += [(g, i) for i in range(n)]
        edges += [(g, a, b, "reference", s) for s, (a, b) in stored] + [(g, a, b, "sibling", 0) for a, b in siblings]
        want += [(g, i, int(x)) for i, x in enumerate(level)]
    edges += [(3, 9_999, 0, "reference", 0), (None, 1, 2, "reference", 0)]
    nodes = spark.createDataFrame(nodes, "graph_id long, file_id long")
    edges = spark.createDataFrame(edges, "graph_id long, from_id long, to_id long, kind string, seq long")
    for large in (0, 1_000_000):
        assert sorted(map(tuple, layout.graph_levels(nodes, edges, large=large).collect())) == sorted(want)


def test_levels_of_rings_with_ways_across_by_joins(spark, monkeypatch):
    """Rings in stored order with items that are nodes of the ring too are solved by joins; what another reference than the last one decides is left to a task."""
    rng, left = np.random.default_rng(6), []
    solve = layout.last_levels
    monkeypatch.setattr(layout, "last_levels", lambda *frames: (lambda found: left.extend(r[0] for r in found[1].collect()) or found)(solve(*frames)))
    nodes, edges, want = [], [], []
    for g in range(40):
        n = int(rng.integers(2, 40))
        if g < 10:
            refs = [(i, (i + 1) % n) for i in range(n)] + [(i, n // 2 + 4 * i + j) for i in range(n) for j in range(1, 4)]  # some of them in the ring
        elif g < 20:
            refs = [(i + 1, i) for i in range(n)] + [(int(a), int(a) - 2) for a in range(2, n, 3)]
        else:
            refs = [tuple(map(int, r)) for r in rng.integers(0, n, (int(rng.integers(n, 2 * n)), 2))]
            refs = [(min(r), max(r)) for r in refs] if g % 3 else refs
        size = max(max(r) for r in refs) + 1
        stored = sorted(refs)
        level = layout.bounded_levels(np.arange(size), np.array(stored, np.int64), np.empty((0, 2), np.int64))
        nodes += [(g, i) for i in range(size)]
        edges += [(g, a, b, "reference") for a, b in stored]
        want += [(g, i, int(x)) for i, x in enumerate(level)]
    nodes = spark.createDataFrame(nodes, "graph_id long, file_id long")
    edges = spark.createDataFrame(edges, "graph_id long, from_id long, to_id long, kind string")
    assert sorted(map(tuple, layout.graph_levels(nodes, edges, large=0).collect())) == sorted(want)
    assert left and not set(left) & set(range(10))


def state_of(spark, members, edges=(), companions=(), attached=(), top=None):
    m = spark.createDataFrame(list(members), graphs.MEMBERS)
    return graphs.State(m.select("graph_id").distinct(), m, spark.createDataFrame(list(edges), graphs.EDGES), spark.createDataFrame(list(companions), graphs.COMPANIONS), spark.createDataFrame([], graphs.COLOR_MAPS), spark.createDataFrame(list(attached), graphs.ATTACHMENTS), top or max(g for g, _ in members))


EDGE = "from_id long, to_id long, kind string"


def test_merge_keeps_the_larger_graph_and_reconciles(spark):
    state = state_of(spark, [(1, 1), (2, 2), (2, 3), (2, 4)], companions=[(2, 5), (1, 9)])
    after = graphs.merge_links(state, spark.createDataFrame([(1, 2, "reference"), (3, 5, "sibling")], EDGE))
    assert rows(after.members) == [(2, 1), (2, 2), (2, 3), (2, 4), (2, 5)]
    assert rows(after.graphs) == [(2,)] and rows(after.companions) == [(2, 9)]
    again = graphs.merge_links(after, spark.createDataFrame([(1, 2, "reference")], EDGE))
    assert rows(again.edges) == rows(after.edges)


def test_merge_tie_and_new_ids(spark):
    state = state_of(spark, [(7, 1), (4, 2)], top=9)
    after = graphs.merge_links(state, spark.createDataFrame([(1, 2, "reference"), (20, 21, "sibling")], EDGE))
    assert rows(after.members) == [(10, 20), (10, 21), (4, 1), (4, 2)] and after.top_id == 10


def test_merge_in_parts_gives_the_same_groups(spark):
    links = [(1, 2, "reference"), (3, 4, "sibling"), (2, 3, "reference"), (8, 9, "sibling"), (6, 6, "reference")]
    whole = graphs.merge_links(graphs.empty_state(spark), spark.createDataFrame(links, EDGE))
    parts = graphs.merge_links(graphs.merge_links(graphs.empty_state(spark), spark.createDataFrame(links[:2], EDGE)), spark.createDataFrame(links[2:], EDGE))
    groups = lambda s: sorted(sorted(r["f"]) for r in s.members.groupBy("graph_id").agg(F.collect_list("file_id").alias("f")).collect())
    assert groups(whole) == groups(parts) == [[1, 2, 3, 4], [6], [8, 9]]


def test_removal_never_splits_and_collects_what_is_empty(spark):
    now = datetime(2026, 1, 1)
    state = state_of(spark, [(1, 1), (1, 2), (2, 5)], [(1, 1, 2, "reference")], [(2, 1)], [(1, 2, "upload", "a", "s1", None, 1, now), (2, 2, "reference", "b", "", "/x", 1, now), (3, 1, "export", "c", "s3", None, 1, now)])
    gone = spark.createDataFrame([(1, 2, "reference")], EDGE)
    edges, _ = relations.remove_relations(state.edges, state.companions, state.members, gone)
    assert edges.isEmpty() and rows(replace(state, edges=edges).members) == [(1, 1), (1, 2), (2, 5)]
    after, files = graphs.remove_members(state, spark.createDataFrame([(5,), (2,)], "file_id long"))
    assert rows(after.graphs) == [(1,)] and rows(after.members) == [(1, 1)] and after.edges.isEmpty() and after.companions.isEmpty()
    assert rows(files) == [("s1",)] and rows(after.attachments, "id") == [(3,)]


def test_companions(spark):
    state = state_of(spark, [(1, 1), (1, 2)])
    asked = spark.createDataFrame([(1, 2), (1, 1), (1, 3), (1, 3), (8, 1)], "owner_id long, other_id long")
    after = graphs.attach_companions(state, asked)
    assert rows(after.companions) == [(1, 3), (2, 1)] and rows(after.members) == [(1, 1), (1, 2), (2, 8)]


def test_self_link_comes_before_unknown_kind(spark):
    links = spark.createDataFrame([(1, 1, "cousin"), (1, 9, "cousin"), (1, 2, "cousin"), (2, 1, "sibling"), (2, 1, "parent"), (None, 1, "child")], "doc_id long, other_id long, ui_kind string")
    found = relations.normalize_relations(links, spark.createDataFrame([(1,), (2,)], "id long"))
    assert [tuple(r) for r in found.select("reason", "from_id", "to_id").collect()].count(("self_link", None, None)) == 1
    assert rows(found, "reason", "from_id", "to_id") == sorted([("self_link", None, None), ("unknown_document", None, None), ("unknown_document", None, None), ("unknown_kind", None, None), (None, 1, 2), (None, 1, 2)], key=repr)


PATCH = "seq long, id long, title string, folder_id long, move_to_root boolean, sort_order int"


def test_file_patches_fold_in_order(spark):
    files = spark.createDataFrame([(1, "/a.md", "old", 9, 5), (2, "/b.md", "b", 9, 6), (3, "/c.md", "c", 9, 7)], "id long, full_path string, title string, folder_id long, sort_order int")
    p = spark.createDataFrame([(1, 1, " a ", None, None, None), (2, 1, None, None, True, None), (3, 1, None, 3, None, 8), (4, 2, "  ", 3, True, None)], PATCH)
    assert rows(patches.apply_file_patches(files, p), "id", "title", "folder_id", "sort_order") == [(1, "a", 3, 8), (2, "", None, 6), (3, "c", 9, 7)]


FOLDERS = "id long, name string, parent_id long, sort_order int"
FOLDER_PATCH = "seq long, id long, name string, parent_id long, move_to_root boolean, sort_order int"


def test_folder_patches_reject_cycles_whole(spark):
    folders = spark.createDataFrame([(1, "a", None, 1), (2, "b", 1, 2), (3, "c", 2, 3), (4, "d", None, 4)], FOLDERS)
    p = spark.createDataFrame([(1, 1, "new", 3, None, None), (2, 4, None, 3, None, None), (3, 3, None, 4, None, None), (4, 2, " z ", None, True, 9)], FOLDER_PATCH)
    after, bad = hierarchy.apply_folder_patches(folders, p)
    assert rows(after) == [(1, "a", None, 1), (2, "z", None, 9), (3, "c", 2, 3), (4, "d", 3, 4)]
    assert rows(bad, "seq") == [(1,), (3,)]


def one_by_one(folders, asked):
    """Folders after requests in order of seq, taken singly, and the seqs of those refused."""
    name, parent, order = ({f[0]: f[i] for f in folders} for i in (1, 2, 3))
    refused = []
    for seq, own, new_name, to, to_root, sort in sorted(asked):
        if own not in name:
            continue
        if not to_root and to is not None:
            at, steps = to, 0
            while at in name and at != own and parent[at] is not None and steps < 999:
                at, steps = parent[at], steps + 1
            if at == own:
                refused.append(seq)
                continue
        name[own] = new_name.strip() if new_name is not None else name[own]
        parent[own] = None if to_root else to if to is not None else parent[own]
        order[own] = sort if sort is not None else order[own]
    return sorted((i, name[i], parent[i], order[i]) for i in name), refused


@pytest.mark.parametrize("batch", [5, 100_000])
def test_folder_patches_equal_single_requests(spark, monkeypatch, batch):
    monkeypatch.setattr(hierarchy, "MOVES", batch)
    rng = np.random.default_rng(batch)
    folders = [(i, f"f{i}", None if i < 3 else int(rng.integers(0, i)), i) for i in range(30)] + [(40, "x", 41, 1), (41, "y", 40, 1), (42, "z", 99, 1)]
    some = lambda value, share: value if rng.random() < share else None
    asked = [(int(seq), int(rng.integers(0, 45)), some(f" n{seq} ", 0.3), some(int(rng.integers(0, 45)), 0.7), some(bool(rng.random() < 0.5), 0.2), some(int(seq), 0.3)) for seq in rng.permutation(25 if batch == 5 else 120)]
    after, bad = hierarchy.apply_folder_patches(spark.createDataFrame(folders, FOLDERS), spark.createDataFrame(asked, FOLDER_PATCH))
    wanted, refused = one_by_one(folders, asked)
    assert sorted(tuple(r) for r in after.collect()) == wanted or rows(after) == sorted(wanted, key=repr)
    assert [r["seq"] for r in bad.orderBy("seq").collect()] == refused and refused


def test_later_moves_see_earlier_ones(spark):
    folders = spark.createDataFrame([(1, "a", None, 1), (2, "b", None, 2)], FOLDERS)
    p = spark.createDataFrame([(1, 1, "new", None, None, None), (2, 1, None, 2, None, None), (3, 2, None, 1, None, None)], FOLDER_PATCH)
    after, bad = hierarchy.apply_folder_patches(folders, p)
    assert rows(after) == [(1, "new", 2, 1), (2, "b", None, 2)] and rows(bad, "seq") == [(3,)]
    none = hierarchy.apply_folder_patches(folders, p.limit(0))
    assert rows(none[0]) == rows(folders) and none[1].isEmpty()


def test_deleted_cycles_leave_their_children_at_the_root(spark):
    folders = spark.createDataFrame([(1, "a", 2, 1), (2, "b", 3, 1), (3, "c", 1, 1), (4, "below", 1, 1), (5, "deeper", 4, 1), (6, "gone", 4, 1), (7, "under", 6, 1)], FOLDERS)
    kept, moved = hierarchy.delete_folders(folders, spark.createDataFrame([(9, 3), (8, 6)], "id long, folder_id long"), spark.createDataFrame([(1,), (2,), (3,), (6,)], "id long"))
    assert rows(kept, "id", "parent_id") == [(4, None), (5, 4), (7, 4)] and rows(moved) == [(8, 4), (9, None)]


def test_tree(spark):
    folders = spark.createDataFrame([(1, "a", None, 1), (2, "b", 1, 1), (3, "lost", 99, 1), (4, "x", 5, 1), (5, "y", 4, 1)], FOLDERS)
    files = spark.createDataFrame([(1, "t", 1, 1), (2, "u", 2, 1), (3, "v", None, 0), (4, "w", 3, 1)], "id long, title string, folder_id long, sort_order int")
    tree = [tuple(r) for r in hierarchy.flatten_tree(folders, files).collect()]
    assert tree == [(0, 1, "a", 0), (0, 2, "b", 1), (1, 2, "u", 2), (1, 1, "t", 1), (1, 3, "v", 0)]
    folded = hierarchy.flatten_tree(folders, files, spark.createDataFrame([(2,)], "id long"))
    assert [r["id"] for r in folded.collect()] == [1, 2, 1, 3]
    kept, moved = hierarchy.delete_folders(folders, files, spark.createDataFrame([(1,), (2,)], "id long"))
    assert rows(moved, "id", "folder_id") == [(1, None), (2, None), (3, None), (4, 3)] and kept.count() == 3


def test_validators(spark):
    inventory = spark.createDataFrame([("/d/a.md", 1), ("/d/b.txt", 1), ("/d/c.md", 1)], "path string, length long")
    files = spark.createDataFrame([(5, "/d/A.md", "A")], "id long, full_path string, title string")
    asked = spark.createDataFrame([("  ",), ("/d/b.txt",), ("/d/no.md",), ("/d/./a.md",), ("/d/c.md",), (None,)], "path string")
    assert rows(ingest.validate_adds(asked, inventory, files), "reason", "existing_id") == sorted([("blank", None), ("extension", None), ("not_on_disk", None), ("managed", 5), (None, None), ("blank", None)], key=repr)
    new = spark.createDataFrame([("/d", " "), ("/e", "x"), ("/d", "x/y"), ("/d", "x.txt"), ("/d", "a"), ("/d", "c.md"), ("/d", " n ")], "dir string, name string")
    got = rows(ingest.validate_new_files(new, inventory, files), "reason", "full_path", "body")
    assert (None, "/d/n.md", "# n\n") in got and {r[0] for r in got} == {None, "blank", "no_directory", "invalid_name", "extension", "managed", "exists"}
    members = spark.createDataFrame([(1, 5)], "graph_id long, file_id long")
    there = spark.createDataFrame([(1, 1, "reference", "a.md", "", "/d/a.md", 1, None)], graphs.ATTACHMENTS)
    req = spark.createDataFrame([(9, "reference", "/d/a.md", None, 0), (5, "reference", " ", None, 0), (5, "reference", "/d/z", None, 0), (5, "reference", " /d/a.md", None, 0), (5, "reference", "/d/c.md", None, 0), (5, "upload", None, None, 3), (5, "upload", None, "x.PDF", 0)], "doc_id long, kind string, path string, file_name string, size_bytes long")
    out = attachments.validate_attachments(req, files, inventory, members, there)
    assert rows(out, "reason", "name") == sorted([("unknown_document", "a.md"), ("blank", ""), ("not_on_disk", "z"), ("attached", "a.md"), (None, "c.md"), (None, "file"), ("empty", "x.PDF")], key=repr)


def test_color_maps(spark):
    maps = spark.createDataFrame([(1, "/m/a.json", '{"LISTNAME":" ","files":[{"FilePath":"x/A.md","COLOR":"#1"},{"filePath":"y\\\\a.MD","color":"#2"},{"filePath":"","color":"#3"}]}'), (2, "/m/b.json", "null"), (3, "/m/c.json", "[]"), (4, "/m/d.json", '{"files":[{"filePath":" "}]}')], "id long, file_path string, json string")
    found = colormaps.validate_color_maps(maps)
    assert rows(found, "id", "reason", "list_name")[0] == (1, None, "a.json")
    assert [r[1] for r in rows(found, "id", "reason")] == [None, "invalid", "invalid", "empty"]
    assert rows(colormaps.color_by_basename(found.where("reason is null"))) == [(1, "a.md", "#2")]
    nodes = spark.createDataFrame([("/z/a.MD", "t"), ("", "A.md"), ("/z/q.md", "a.md")], "path string, title string")
    assert rows(colormaps.node_colors(nodes, colormaps.color_by_basename(found.where("reason is null")), 1), "title", "color") == [("A.md", "#2"), ("a.md", None), ("t", "#2")]


def test_export_page(spark):
    nodes = spark.createDataFrame([(1, 1, "A & B", False), (1, 2, "", True)], "graph_id long, id long, title string, missing boolean")
    edges = spark.createDataFrame([(1, 1, 2, "reference")], graphs.EDGES)
    placed = layout.graph_layout(nodes.select("graph_id", F.col("id").alias("file_id")), edges)
    html = export.export_index(nodes, edges, placed, spark.createDataFrame([(1, 1)], "graph_id long, active_id long")).first()["html"]
    assert "<title>A &amp; B — graph export</title>" in html and '<a href="1-a-b.md">A &amp; B</a>' in html and "(missing)" in html
    assert 'd="M 0 19 L 0 91"' in html and 'href="2-doc.md"' not in html and ">#2</text>" in html


def test_texts(spark):
    content = spark.createDataFrame([(1, "a\n```py\nx\n```\n~~~\ny\n~~~\n```\n```\n[l](b.md) http://x.y/z <https://q.r> [m](<c d.md>)"), (2, None), (3, "")], "file_id long, text string")
    assert rows(text_inventory.fence_inventory(content), "lang", "kind", "n") == [("", "plain", 2), ("py", "code", 1)]
    assert ("b.md", False, 1) in rows(text_inventory.link_inventory(content)) and ("http://x.y/z", True, 1) in rows(text_inventory.link_inventory(content))


def test_components_of_a_chain_a_hub_and_nothing(spark):
    chain = spark.range(300).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    hub = spark.range(1, 200).select(F.lit(1000).cast("long").alias("from_id"), (F.col("id") + 1000).alias("to_id"))
    found = connected_components(chain.union(hub).union(spark.createDataFrame([(5000, 5000), (None, 1)], "from_id long, to_id long")))
    assert rows(found.groupBy("component").count()) == [(0, 301), (1000, 200), (5000, 1)]
    assert connected_components(spark.createDataFrame([], "from_id long, to_id long")).isEmpty()


@pytest.mark.parametrize("forest", [7, 100, 500_000])
def test_contracted_components_equal_the_others(spark, monkeypatch, forest):
    from leafgraph.operators import components

    monkeypatch.setattr(components, "FOREST", forest)
    edges = spark.range(400).selectExpr("xxhash64(id) % 150 as from_id", "xxhash64(id, 1) % 150 as to_id").union(spark.createDataFrame([(500, 500), (None, 1), (600, 601), (601, 600)], "from_id long, to_id long"))
    edges = edges.union(spark.range(200).selectExpr("1000 + id * 7 % 201", "1000 + (id + 1) * 7 % 201")).repartition(5)
    assert rows(connected_components(edges, contract=True), "id", "component") == rows(connected_components(edges), "id", "component")
    assert connected_components(edges.limit(0), contract=True).isEmpty()


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    assert sorted(r["n"] for r in number_rows(df, ["id"], "n", 5).collect()) == list(range(5, 1005))
    found = number_within(df, ["k"], ["id"], "n", salts=8).collect()
    for k in range(3):
        assert sorted(r["n"] for r in found if r["k"] == k) == list(range(len([r for r in found if r["k"] == k])))
    assert number_rows(df.limit(0), ["id"], "n").isEmpty() and number_within(df.limit(0), ["k"], ["id"], "n").isEmpty()


def test_a_title_asked_often_is_met_in_pieces(spark, monkeypatch):
    from leafgraph.operators import ingest

    monkeypatch.setattr(ingest, "PIECE", 7)
    titles = [f"{a} {b}" for a in ("Red", "rod", "Blue") for b in range(30)]
    files = spark.createDataFrame([(i, t, i % 4) for i, t in enumerate(titles)], "id long, title string, sort_order int")
    asked = [(100 + i, ["", "R", "d 1", "blue", "zzz", None][i % 6], i if i % 2 else None) for i in range(60)]
    queries = spark.createDataFrame(asked, "query_id long, q string, exclude_id long")
    wanted = sorted((n, i, t) for n, q, own in asked if q is not None for i, t in enumerate(titles) if q.lower() in t.lower() and i != own)
    found = ingest.search_titles(files, queries, ordered=False)
    assert sorted(tuple(r) for r in found.collect()) == wanted
    place = {i: (i % 4, t, i) for i, t in enumerate(titles)}
    assert [tuple(r) for r in ingest.search_titles(files, queries).collect()] == sorted(wanted, key=lambda r: (r[0], place[r[1]]))


def test_a_chain_hangs_from_its_top_in_few_rounds(spark, monkeypatch):
    n = 5_000
    chain = spark.range(1, n).selectExpr("id % 2 as graph_id", "id", "case when id > 3 then id - 2 when id = 3 then null else id - 2 end as up", "id as w")
    steps, further = [], layout.cut
    monkeypatch.setattr(layout, "cut", lambda df: steps.append(1) or further(df))
    for held, most in ((1_000_000, 8), (700, 12)):
        monkeypatch.setattr(layout, "HELD", held, raising=False)
        steps.clear()
        found = {r["id"]: (r["top"], r["w"]) for r in layout._tops(chain).collect()}
        assert len(steps) <= most
        wanted = {1: (-1, 1), 2: (0, 2), 3: (None, 3)}
        for i in range(4, n):
            wanted[i] = wanted[i - 2][0], wanted[i - 2][1] + i
        assert found == wanted
    with pytest.raises(RuntimeError):
        layout._tops(spark.range(10).selectExpr("1L as graph_id", "id", "(id + 1) % 10 as up", "1L as w"))
