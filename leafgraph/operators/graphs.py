"""Document graphs as state: building, merging, companions, removal and collection of what is empty."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.operators.components import connected_components
from leafgraph.operators.numbering import number_rows
from leafgraph.operators.relations import distinct_edges, joining_edges, valid_endpoints
from leafgraph.session import cut, shuffled, small_side

GRAPHS, MEMBERS, EDGES, COMPANIONS = "graph_id long", "graph_id long, file_id long", "graph_id long, from_id long, to_id long, kind string", "graph_id long, file_id long"
COLOR_MAPS = "id long, graph_id long, file_path string, list_name string, json string"
ATTACHMENTS = "id long, graph_id long, kind string, file_name string, stored_name string, source_path string, size_bytes long, created_utc timestamp"


@dataclass(frozen=True)
class State:
    """The tables of the graphs. top_id: the largest graph id ever given, so that ids are never used again."""

    graphs: DataFrame
    members: DataFrame
    edges: DataFrame
    companions: DataFrame
    color_maps: DataFrame
    attachments: DataFrame
    top_id: int = 0


def empty_state(spark) -> State:
    return State(*[spark.createDataFrame([], s) for s in (GRAPHS, MEMBERS, EDGES, COMPANIONS, COLOR_MAPS, ATTACHMENTS)])


def written(state: State) -> State:
    """The state with each of its tables written to the shared folder, so that what is built on it has a short plan."""
    return replace(state, **{f.name: cut(getattr(state, f.name)) for f in fields(state) if f.name != "top_id"})


def graph_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("graph_id").agg(F.count("*").alias("n"))


def member_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """(graph_id, then the columns of files): members without a catalog row drop out."""
    return members.join(shuffled(files.withColumnRenamed("id", "file_id")), "file_id").select("graph_id", F.col("file_id").alias("id"), *[c for c in files.columns if c != "id"])


def ensure_singletons(state: State, doc_ids: DataFrame) -> State:
    """A new graph of one member for each of doc_ids (doc_id) that is in none, numbered in the order of the ids."""
    loose = doc_ids.select(F.col("doc_id").alias("file_id")).distinct().join(shuffled(state.members), "file_id", "left_anti")
    made = cut(number_rows(loose, ["file_id"], "graph_id", state.top_id + 1))
    top = max(state.top_id, made.agg(F.max("graph_id")).first()[0] or 0)
    return replace(state, graphs=state.graphs.unionByName(made.select("graph_id")), members=state.members.unionByName(made.select("graph_id", "file_id")), top_id=top)


def attach_legacy_companions(links: DataFrame, state: State) -> State:
    """Companion links (from_id, to_id, kind) of the old list, both ways: each document becomes a companion in the other's graph, unless both are in one.

    The ends are documents. One that is in no graph gets its own first, so that afterwards a pair is apart if its graphs differ.
    """
    pairs = links.where("kind = 'companion' and from_id <> to_id").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    state = ensure_singletons(state, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    graph = lambda end: shuffled(state.members.select(F.col("file_id").alias(end), F.col("graph_id").alias(f"g{end}")))
    apart = pairs.join(graph("a"), "a").join(graph("b"), "b").where("ga <> gb")
    ways = F.array(F.struct(F.col("ga").alias("graph_id"), F.col("b").alias("file_id")), F.struct(F.col("gb").alias("graph_id"), F.col("a").alias("file_id")))
    return replace(state, companions=state.companions.unionByName(apart.select(F.inline(ways))).distinct())


def attach_companions(state: State, requests: DataFrame) -> State:
    """Requests (owner_id, other_id), one way: the other joins the owner's graph, which is made on demand. The owner
    itself and members of the graph are refused, an existing companion is left as it is."""
    wanted = requests.where("owner_id <> other_id").select("owner_id", "other_id").distinct()
    state = ensure_singletons(state, wanted.select(F.col("owner_id").alias("doc_id")))
    made = wanted.join(shuffled(state.members.withColumnRenamed("file_id", "owner_id")), "owner_id").select("graph_id", F.col("other_id").alias("file_id")).distinct()
    made = made.join(shuffled(state.members), ["graph_id", "file_id"], "left_anti")
    return replace(state, companions=state.companions.unionByName(made).distinct())


def reconcile_companions(companions: DataFrame, members: DataFrame) -> DataFrame:
    """companions without those that are members of the same graph."""
    return companions.join(shuffled(members), ["graph_id", "file_id"], "left_anti").select("graph_id", "file_id")


def resolve_legacy_attachments(attachments: DataFrame, files: DataFrame, state: State) -> tuple[State, DataFrame]:
    """Attachments by document (id, file_id, file_name, stored_name, size_bytes, created_utc) moved to the document's graph.

    Also the orphans, whose document is gone: they are dropped and their stored files are to be deleted.
    """
    known = shuffled(files.select(F.col("id").alias("file_id")).distinct())
    kept = attachments.join(known, "file_id", "left_semi")
    state = ensure_singletons(state, attachments.select("file_id").distinct().join(known, "file_id").select(F.col("file_id").alias("doc_id")))
    moved = kept.join(shuffled(state.members), "file_id").select("id", "graph_id", F.lit("export").alias("kind"), "file_name", "stored_name", F.lit(None).cast("string").alias("source_path"), "size_bytes", "created_utc")
    return replace(state, attachments=state.attachments.unionByName(moved)), attachments.join(known, "file_id", "left_anti")


def component_members(files: DataFrame, relations: DataFrame) -> DataFrame:
    """(file_id, component) of the documents on a reference or sibling link whose ends both exist; component: the least id."""
    return _members_of(valid_endpoints(joining_edges(relations).distinct(), files))


def _members_of(links: DataFrame) -> DataFrame:
    return connected_components(joining_edges(links), contract=True).select(F.col("id").alias("file_id"), "component")


def build_graphs(files: DataFrame, relations: DataFrame, legacy_attachments: DataFrame | None = None) -> tuple[State, DataFrame | None]:
    """The graphs of an old list of relations: components, members, edges, companions, attachments; and orphaned attachments.

    Graph ids follow the least member's order. Self-loops stay, as a graph of one document with its edge. Repeated links
    change nothing, so each is held against the files once. A companion has a graph of its own, other than the one it is
    attached to, so none is a member there as well.
    """
    state = empty_state(files.sparkSession)
    links = cut(valid_endpoints(distinct_edges(relations), files))
    found = cut(_members_of(links))
    ids = cut(number_rows(found.select("component").distinct(), ["component"], "graph_id"))
    members = cut(found.join(small_side(ids), "component").select("graph_id", "file_id"))
    top = ids.agg(F.max("graph_id")).first()[0] or 0
    # The ends of an edge are in one component, so the graph of one end is the edge's.
    edges = joining_edges(links).join(shuffled(members.withColumnRenamed("file_id", "from_id")), "from_id").select("graph_id", "from_id", "to_id", "kind")
    state = attach_legacy_companions(links, replace(state, graphs=ids.select("graph_id"), members=members, edges=edges, top_id=top))
    orphans = None
    if legacy_attachments is not None:
        state, orphans = resolve_legacy_attachments(legacy_attachments, files, state)
    return state, orphans


def merge_survivor(sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, graph_id): of the graphs (component, graph_id) that become one, the one with the most members before; ties: the smallest id."""
    return groups.join(shuffled(sizes), "graph_id").groupBy("component").agg(F.max_by("graph_id", F.struct("n", -F.col("graph_id"))).alias("graph_id"))


def merge_links(state: State, new_edges: DataFrame) -> State:
    """State after a batch of edges (from_id, to_id, kind) in normal form; an edge that exists already changes nothing.

    Only what the batch touches is solved: graphs and loose documents become nodes of a small graph whose components are
    the graphs afterwards. Rows whose graph goes get the survivor's id by a join with the map of changed ids.
    """
    # Grouped rather than joined, so that neither side is sorted by three keys.
    known = state.edges.select("from_id", "to_id", "kind", F.lit(True).alias("__known"))
    found = joining_edges(new_edges).withColumn("__known", F.lit(False)).unionByName(known).groupBy("from_id", "to_id", "kind").agg(F.max("__known").alias("__known"))
    fresh = cut(found.where("not __known").drop("__known"))
    if fresh.isEmpty():
        return state
    graph = state.members.select(F.col("file_id").alias("__f"), F.col("graph_id").alias("__g"))
    node = lambda g, f: F.when(g.isNotNull(), g * 2).otherwise(f * 2 + 1).cast("long")  # noqa: E731  even: a graph, odd: a loose document
    ends = fresh.join(shuffled(graph.withColumnsRenamed({"__f": "__fa", "__g": "ga"})), F.col("from_id") == F.col("__fa"), "left").join(shuffled(graph.withColumnsRenamed({"__f": "__fb", "__g": "gb"})), F.col("to_id") == F.col("__fb"), "left")
    solved = cut(connected_components(ends.select(node(F.col("ga"), F.col("from_id")).alias("a"), node(F.col("gb"), F.col("to_id")).alias("b")), "a", "b", contract=True))
    old = solved.where("pmod(id, 2) = 0").select("component", F.shiftright("id", 1).alias("graph_id"))
    survivors = merge_survivor(graph_sizes(state.members), old)
    wholly_new = solved.select("component").distinct().join(shuffled(old), "component", "left_anti")
    made = cut(number_rows(wholly_new, ["component"], "graph_id", state.top_id + 1))
    final = cut(survivors.unionByName(made.select("component", "graph_id")).withColumnRenamed("graph_id", "new_id"))
    moves = small_side(cut(old.join(shuffled(final), "component").where("graph_id <> new_id").select("graph_id", "new_id")))
    joined = solved.where("pmod(id, 2) = 1").join(shuffled(final), "component").select(F.col("new_id").alias("graph_id"), F.shiftright("id", 1).alias("file_id"))

    def moved(df: DataFrame) -> DataFrame:
        return df.join(moves, "graph_id", "left").withColumn("graph_id", F.coalesce("new_id", "graph_id")).select(df.columns)

    members = cut(moved(state.members).unionByName(joined))
    edges = moved(state.edges).unionByName(fresh.join(shuffled(members.select(F.col("file_id").alias("from_id"), "graph_id")), "from_id").select("graph_id", "from_id", "to_id", "kind"))
    graphs = state.graphs.join(moves, "graph_id", "left_anti").unionByName(made.select("graph_id"))
    companions = reconcile_companions(moved(state.companions).distinct(), members)
    top = max(state.top_id, made.agg(F.max("graph_id")).first()[0] or 0)
    return State(graphs, members, edges, companions, moved(state.color_maps), moved(state.attachments), top)


def stored_files_to_delete(attachments: DataFrame) -> DataFrame:
    """(stored_name): what a removal of these attachments leaves on disk; referenced files are never the application's to delete."""
    return attachments.where(F.col("kind").isin("export", "upload") & (F.coalesce("stored_name", F.lit("")) != "")).select("stored_name").distinct()


def gc_graphs(state: State, touched: DataFrame) -> tuple[State, DataFrame]:
    """State without the graphs of touched (graph_id) that have no member left, and the stored files that go with them."""
    empty = small_side(cut(touched.select("graph_id").distinct().join(shuffled(state.members), "graph_id", "left_anti")))
    gone = stored_files_to_delete(state.attachments.join(empty, "graph_id", "left_semi"))
    keep = lambda df: df.join(empty, "graph_id", "left_anti").select(df.columns)
    return replace(state, graphs=keep(state.graphs), companions=keep(state.companions), color_maps=keep(state.color_maps), attachments=keep(state.attachments)), gone


def remove_members(state: State, file_ids: DataFrame) -> tuple[State, DataFrame]:
    """State without these members (file_id) and their edges; what is left of a graph stays one graph. Also the stored files to delete."""
    ids = small_side(cut(file_ids.select("file_id").distinct()))
    touched = cut(state.members.join(ids, "file_id", "left_semi").select("graph_id").distinct())
    edges = state.edges.join(ids.withColumnRenamed("file_id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("file_id", "to_id"), "to_id", "left_anti")
    members = state.members.join(ids, "file_id", "left_anti")
    return gc_graphs(replace(state, members=members.select("graph_id", "file_id"), edges=edges.select("graph_id", "from_id", "to_id", "kind")), touched)


def remove_files(state: State, files: DataFrame, file_ids: DataFrame) -> tuple[State, DataFrame, DataFrame]:
    """(state, files, stored files to delete) without these documents in any role."""
    state, gone = remove_members(state, file_ids)
    ids = shuffled(file_ids.select("file_id").distinct())
    companions = state.companions.join(ids, "file_id", "left_anti").select("graph_id", "file_id")
    return replace(state, companions=companions), files.join(ids, files["id"] == ids["file_id"], "left_anti"), gone


def graph_view(state: State, files: DataFrame) -> DataFrame:
    """(graph_id, nodes, edges, companions): nested, each list in a fixed order; files needs id, title, full_path and missing.

    Nodes and companions need a catalog row, edges do not. Keep to the flat tables where graphs may be huge.
    """
    node = F.struct("id", "title", "missing", F.col("full_path").alias("path"))
    nodes = member_files(state.members, files).groupBy("graph_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    edges = state.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("from_id", "to_id", "kind"))).alias("edges"))
    companions = member_files(state.companions, files).groupBy("graph_id").agg(F.array_sort(F.collect_list(node)).alias("companions"))
    return state.graphs.join(nodes, "graph_id", "left").join(edges, "graph_id", "left").join(companions, "graph_id", "left")


def view_of(doc_ids: DataFrame, state: State, files: DataFrame) -> DataFrame:
    """(active_id, then the columns of graph_view) of each document; one in no graph is a view of itself alone."""
    graph = doc_ids.select(F.col("doc_id").alias("active_id")).join(state.members.withColumnRenamed("file_id", "active_id"), "active_id", "left")
    alone = files.select(F.col("id").alias("active_id"), F.array(F.struct("id", "title", "missing", F.col("full_path").alias("path"))).alias("__self"))
    return graph.join(graph_view(state, files), "graph_id", "left").join(alone, "active_id", "left").select("active_id", "graph_id", F.coalesce("nodes", F.when(F.col("graph_id").isNull(), F.col("__self"))).alias("nodes"), "edges", "companions")
