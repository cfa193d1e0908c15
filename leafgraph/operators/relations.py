"""Links between documents: validation, normal form, assignment to graphs, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.session import shuffled

#: Kinds that join two documents into one graph.
JOINING = ("reference", "sibling")


def normalize_relations(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (doc_id, other_id, ui_kind, ...) with from_id, to_id, kind and reason (null: accepted).

    The first that holds: self_link, unknown_document (either end), unknown_kind. A parent is the from end of a
    reference, a child its to end; siblings run from the smaller id to the larger.
    """
    ids = files.select(F.col("id").alias("__id")).distinct()
    a, b, ui = F.col("doc_id"), F.col("other_id"), F.col("ui_kind")
    joined = links.join(ids.withColumnRenamed("__id", "__a"), a == F.col("__a"), "left").join(ids.withColumnRenamed("__id", "__b"), b == F.col("__b"), "left")
    kind = F.when(ui.isin("parent", "child", "reference"), "reference").when(ui == "sibling", "sibling").when(ui == "companion", "companion")
    reason = F.when(a == b, "self_link").when(F.col("__a").isNull() | F.col("__b").isNull(), "unknown_document").when(kind.isNull(), "unknown_kind")
    start = F.when(ui == "parent", b).when(ui == "sibling", F.least(a, b)).otherwise(a)
    end = F.when(ui == "parent", a).when(ui == "sibling", F.greatest(a, b)).otherwise(b)
    ok = reason.isNull()
    return joined.select(*[links[c] for c in links.columns], F.when(ok, start).alias("from_id"), F.when(ok, end).alias("to_id"), F.when(ok, kind).alias("kind"), reason.alias("reason"))


def valid_endpoints(links: DataFrame, files: DataFrame) -> DataFrame:
    """The links both of whose ends are documents."""
    ids = shuffled(files.select(F.col("id").alias("__id")).distinct())
    return links.join(ids, F.col("from_id") == F.col("__id"), "left_semi").join(ids, F.col("to_id") == F.col("__id"), "left_semi")


def joining_edges(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("kind").isin(*JOINING)).select("from_id", "to_id", "kind")


def distinct_edges(relations: DataFrame) -> DataFrame:
    return relations.select("from_id", "to_id", "kind").distinct()


def distinct_pairs(relations: DataFrame) -> DataFrame:
    """(a, b): each unordered pair of ends once, a the smaller."""
    return relations.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()


def assign_edges(relations: DataFrame, members: DataFrame) -> DataFrame:
    """(graph_id, from_id, to_id, kind): distinct reference and sibling edges whose ends are in one graph."""
    a = members.select(F.col("file_id").alias("from_id"), F.col("graph_id"))
    b = members.select(F.col("file_id").alias("to_id"), F.col("graph_id").alias("__g"))
    return distinct_edges(joining_edges(relations)).join(shuffled(a), "from_id").join(shuffled(b), "to_id").where("graph_id = __g").select("graph_id", "from_id", "to_id", "kind")


def graph_of(doc_ids: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, graph_id): null for a document that is in no graph."""
    return doc_ids.join(members.withColumnRenamed("file_id", "doc_id"), "doc_id", "left").select("doc_id", "graph_id")


def remove_relations(edges: DataFrame, companions: DataFrame, members: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, companions) without the removals (from_id, to_id, kind, in normal form); graphs are never split by it."""
    kept = edges.join(removals.where("kind <> 'companion'").select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti")
    owners = members.select(F.col("file_id").alias("from_id"), "graph_id")
    gone = removals.where("kind = 'companion'").join(owners, "from_id").select("graph_id", F.col("to_id").alias("file_id"))
    return kept.select(edges.columns), companions.join(gone, ["graph_id", "file_id"], "left_anti").select(companions.columns)
