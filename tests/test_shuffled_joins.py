"""Joins of sides that grow with the input go through shuffles, whatever Spark's estimate: nothing of them is sent to the driver."""

import re
from contextlib import contextmanager

import pytest

from leafgraph.operators import graphs, hierarchy
from leafgraph.operators.components import connected_components

FOLDERS = [(i, f"f{i}", None if i < 3 else i // 3, 1) for i in range(1, 60)]
PATCHES = [(n, n % 59 + 1, None, n * 7 % 59 + 1, False, None) for n in range(120)]
#: Keys of broadcasts that have a bound of their own: ranges of a numbering.
BOUNDED = {"__part"}


@contextmanager
def broadcasts(spark):
    """The keys of all joins by broadcast in what runs inside, but for BOUNDED ones."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    found = []
    yield found
    bus.waitUntilEmpty()
    listed = store.executionsList()
    for run in (listed.apply(i) for i in range(listed.size())):
        if run.executionId() not in seen:
            text = run.physicalPlanDescription()
            for number in re.findall(r"BroadcastHashJoin[^\n]*\((\d+)\)", text.split("== Initial Plan ==")[0]):
                key = re.search(rf"\n\({number}\) BroadcastHashJoin[^\n]*\nLeft keys[^:]*: \[(.*?)#", text)
                found.extend([key[1]] if key[1] not in BOUNDED else [])


def test_folder_patches(spark):
    folders = spark.createDataFrame(FOLDERS, "id long, name string, parent_id long, sort_order int")
    patches = spark.createDataFrame(PATCHES, "seq long, id long, name string, parent_id long, move_to_root boolean, sort_order int")
    with broadcasts(spark) as found:
        after, refused = hierarchy.apply_folder_patches(folders, patches)
        assert after.count() == len(FOLDERS) and 0 < refused.count() < len(PATCHES)
    assert found == []


@pytest.mark.parametrize("contract", [False, True])
def test_components(spark, contract):
    edges = spark.createDataFrame([(i, i + 1 if i % 10 else i) for i in range(200)], "from_id long, to_id long")
    with broadcasts(spark) as found:
        assert connected_components(edges, contract=contract).select("component").distinct().count() == 21
    assert found == []


def test_building_graphs_of_repeated_links(spark):
    files = spark.createDataFrame([(i,) for i in range(40)], "id long")
    kinds = ("reference", "companion", "sibling", "see")
    rows = [(i, (i * 7 + 1) % 45, kinds[i % 4]) for i in range(44)]
    once, twice = (spark.createDataFrame(rows * n, "from_id long, to_id long, kind string") for n in (1, 2))
    with broadcasts(spark) as found:
        state = graphs.build_graphs(files, twice)[0]
        tables = [sorted(map(tuple, t.collect())) for t in (state.members, state.edges, state.companions)]
    assert len(found) <= 1  # the graphs' ids, whose size small_side checks
    assert all(tables)
    plain = graphs.build_graphs(files, once)[0]
    assert tables == [sorted(map(tuple, t.collect())) for t in (plain.members, plain.edges, plain.companions)]


def test_links_are_joined_once(spark):
    """The ends of an edge are in one graph and a companion's graphs differ, so an edge takes one join with the members and a companion two."""
    files = spark.createDataFrame([(i,) for i in range(60)], "id long")
    links = [(1, 2, "reference"), (2, 3, "sibling"), (5, 5, "reference")]  # graphs of 1 to 3 and of 5
    links += [(1, 3, "companion"), (3, 1, "companion"), (1, 5, "companion"), (3, 5, "companion"), (9, 2, "companion"), (8, 7, "companion"), (6, 6, "companion"), (4, 99, "companion")]
    state = graphs.build_graphs(files, spark.createDataFrame(links, "from_id long, to_id long, kind string"))[0]
    assert sorted(map(tuple, state.members.collect())) == [(1, 1), (1, 2), (1, 3), (2, 5), (3, 7), (4, 8), (5, 9)]
    assert sorted(map(tuple, state.edges.collect())) == [(1, 1, 2, "reference"), (1, 2, 3, "sibling"), (2, 5, 5, "reference")]
    assert sorted(map(tuple, state.companions.collect())) == [(1, 5), (1, 9), (2, 1), (2, 3), (3, 8), (4, 7), (5, 2)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(df).count("Join ") for df in (state.edges, state.companions)] == [1, 2]


def test_new_edges_are_grouped(spark):
    """New edges are told from known ones by one grouping: no join sorts both by three keys."""
    files = spark.createDataFrame([(i,) for i in range(20)], "id long")
    schema = "from_id long, to_id long, kind string"
    state = graphs.written(graphs.build_graphs(files, spark.createDataFrame([(1, 2, "reference"), (3, 4, "sibling")], schema))[0])
    new = spark.createDataFrame([(1, 2, "reference"), (1, 2, "sibling"), (2, 3, "reference"), (2, 3, "reference"), (6, 7, "sibling"), (8, 9, "companion")], schema)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    after = graphs.merge_links(state, new)
    bus.waitUntilEmpty()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsList().size())]
    assert not any(re.search(r"Left keys \[3\]", p) for p in plans)
    assert sorted(map(tuple, after.members.collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (3, 6), (3, 7)]
    assert sorted(map(tuple, after.edges.collect())) == [(1, 1, 2, "reference"), (1, 1, 2, "sibling"), (1, 2, 3, "reference"), (1, 3, 4, "sibling"), (3, 6, 7, "sibling")]
