"""Connected components of an undirected edge list (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leafgraph.session import cut, release, shuffled

#: Edges of one node from which on a join with its minimum must be one that AQE can split.
HUB = 1_000_000
#: Edges that a task joins to a forest at a time; so many are also joined by one task at last.
FOREST = 500_000


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether all edges (u, v) are stars already, v their centres, and how many edges the busiest node has."""
    up = edges.groupBy("u").agg(F.count("*").alias("nu")).withColumnRenamed("u", "id")
    down = edges.groupBy("v").agg(F.count("*").alias("nv")).withColumnRenamed("v", "id")
    ends = up.join(down, "id", "full").select(F.coalesce("nu", F.lit(0)).alias("nu"), F.coalesce("nv", F.lit(0)).alias("nv"))
    tangled, most = ends.agg(F.max((F.col("nu") > 1) | ((F.col("nu") > 0) & (F.col("nv") > 0))), F.max(F.col("nu") + F.col("nv"))).first()
    return not tangled, most or 0


def _trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of its tree) of the nodes that edges (a, b) join to a lesser one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = np.arange(len(ids))
    up, u, v = own.copy(), at[: len(a)], at[len(a) :]
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while ((top := up[up]) != up).any():
            up = top
        u, v = up[u], up[v]
        u, v = u[u != v], v[u != v]
    hung = up != own
    return ids[hung], ids[up[hung]]


def _forests(edges: DataFrame) -> DataFrame:
    """(u, v) that join what the edges (u, v) of each task join, FOREST edges at a time: each node to the least of its tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= FOREST:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = _trees(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c in found], ["u", "v"])

    name = edges.schema["u"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[name]
    return edges.select("u", "v").mapInArrow(run, f"u {name}, v {name}")


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(edges that are left, leaves of each round): what ranges of nodes join by themselves is contracted and nodes on one edge only are set aside.

    Each round deals the edges by ranges, FOREST to a task, where they become a forest. A node that no other task has hangs
    from the least of its tree, as a leaf (u, v), and waits for that one's component. Rounds go on while they take away a
    quarter of the edges; no more than FOREST edges are joined by one task.
    """
    now, leaves = edges, []
    while (count := now.count()) > FOREST:
        near = cut(_forests(now.repartitionByRange(-(-count // FOREST), "v", "u").sortWithinPartitions("v", "u")))
        ends = near.select("u", "v").unionByName(near.select(F.col("v").alias("u"), F.lit(None).cast(near.schema["v"].dataType).alias("v")).distinct())
        alone = ends.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1 and v is not null")
        leaves.append(cut(alone.select("u", "v")))
        before, now = now, cut(near.join(shuffled(leaves[-1].select("u")), "u", "left_anti").distinct())
        release(near, before if before is not edges else None)
        if now.count() > count * 3 // 4:
            return now, leaves
    return (cut(_forests(now.repartition(1))) if count else now), leaves


def connected_components(edges: DataFrame, src: str = "from_id", dst: str = "to_id", max_rounds: int = 100, contract: bool = False) -> DataFrame:
    """(id, component) of every node on an edge; component is the smallest id that it can reach.

    Direction, repeated edges and extra columns don't matter; a self-loop makes a component of one node; an edge with a
    null end is skipped. Ids may be of any type that Spark orders. Alternating large-star and small-star rounds, O(log^2 n)
    of them; each round's edges go to the shared folder, those of the round before are deleted. Where a node has very many
    edges, the minimum of each node is written before it is joined, so that both sides of the join are plain exchanges,
    which AQE splits where they are skewed. With `contract`, if ids are integers, ranges of edges are first contracted by
    themselves (`_contracted`): rounds are left to what is large and joins nodes of far apart numbers.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    contract = contract and isinstance(ends.schema["u"].dataType, IntegralType)
    ends = cut(ends if contract else ends.distinct())
    nodes = ends.where("u = v").select("u")
    now = ends.where("u <> v")
    now, leaves = _contracted(now) if contract else (cut(now), [])
    first = now
    for _ in range(max_rounds):
        settled, busiest = _shape(now)
        if settled:
            break
        fixed = cut if busiest >= HUB else lambda df: df
        # Large-star: every larger neighbour of u is linked to the least of u's neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least_large = fixed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = cut(both.join(shuffled(least_large), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small-star: u and its smaller neighbours are linked to the least of them.
        least = fixed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(shuffled(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(large, least_large, least, before if before is not first else None)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    for hung in reversed(leaves):  # what they hang from has its component by now, or is one's least node
        tops = now.select(F.col("u").alias("v"), F.col("v").alias("__top"))
        now = cut(now.unionByName(hung.join(shuffled(tops), "v", "left").select("u", F.coalesce("__top", "v").alias("v"))))
    roots = now.select(F.col("v").alias("id")).unionByName(nodes.select(F.col("u").alias("id"))).distinct()
    roots = roots.join(shuffled(now.select(F.col("u").alias("id"))), "id", "left_anti").select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
