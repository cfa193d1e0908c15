"""Approximate nearest neighbours by cross-polytope hashing (Andoni et al., 2015) with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.session import cut, small_side

#: Hash tables, and vectors for each bucket of a table on average.
TABLES, FILL = 4, 8
#: Share of the nearest that the sample's probes must meet, and queries of a length that this is measured on at most (a bounded sample).
RECALL, SAMPLE = 0.95, 64
#: Vectors in a block and queries in a group, buckets that a group's queries probe, candidates kept from each block over k.
BLOCK, ASKED, SPARE = 8_192, 2_000_000, 4
#: Sums of axes that are held at once while buckets are ordered.
SUMS = 4_000_000


def rotation_signs(table: int, polytope: int, size: int, rounds: int = 3) -> np.ndarray:
    """The random signs between the Hadamard transforms of one pseudo-rotation."""
    return np.random.default_rng([20150900, table, size, polytope]).choice([-1.0, 1.0], (rounds, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, made orthonormal."""
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def padded_size(size: int) -> int:
    return 1 << max(1, size - 1).bit_length()


def rotate(x: np.ndarray, table: int, polytope: int) -> np.ndarray:
    """Unit rows, padded to a power of two, under a pseudo-rotation."""
    size = padded_size(x.shape[1])
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    for signs in rotation_signs(table, polytope, size):
        padded = hadamard(padded * signs)
    return padded


def polytopes(rows: int, size: int) -> list[int]:
    """Dimensions that each of a table's polytopes keeps, for about one bucket for FILL of `rows` vectors: all of them as often as that fits, then a part of them."""
    most, left, kept = padded_size(size), max(2.0, rows / FILL), []
    while left > 2 * most:
        kept.append(most)
        left /= 2 * most
    last = 1 << max(0, round(math.log2(left / 2)))
    return [*kept, last] if last > 1 or not kept else kept


def signed_axes(x: np.ndarray, table: int, kept: list[int]) -> list[np.ndarray]:
    """For each polytope how near its signed axes are to each row: axis i is 2i, its opposite 2i + 1."""
    turned = [rotate(x, table, i)[:, :dims] for i, dims in enumerate(kept)]
    return [np.stack([t, -t], axis=2).reshape(len(x), -1) for t in turned]


def nearest_buckets(x: np.ndarray, table: int, kept: list[int], count: int) -> np.ndarray:
    """For each row the `count` buckets nearest to it, the nearest first; a bucket is an axis of each polytope, and near if they are in sum."""
    wide = 2 * max(kept)
    if len(x) > 1 and len(x) * count * wide > SUMS:
        step = max(1, SUMS // (count * wide))
        return np.concatenate([nearest_buckets(x[i : i + step], table, kept, count) for i in range(0, len(x), step)])
    codes, sums = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for signed in signed_axes(x, table, kept):
        axes = signed.shape[1]
        sums = (sums[:, :, None] + signed[:, None, :]).reshape(len(x), -1)
        codes = (codes[:, :, None] * axes + np.arange(axes)).reshape(len(x), -1)
        if count < sums.shape[1]:
            top = sums.argmax(axis=1)[:, None] if count == 1 else np.argpartition(-sums, count - 1, axis=1)[:, :count]
            sums, codes = np.take_along_axis(sums, top, 1), np.take_along_axis(codes, top, 1)
    return np.take_along_axis(codes, np.argsort(-sums, axis=1, kind="stable"), 1)


def bucket_ranks(query: np.ndarray, vectors: np.ndarray, table: int, kept: list[int]) -> np.ndarray:
    """How many buckets are nearer to the query (one row) than that in which each of the vectors lies."""
    near, axes = signed_axes(query, table, kept), [a.argmax(axis=1) for a in signed_axes(vectors, table, kept)]
    own = sum(n[0][a] for n, a in zip(near, axes, strict=True))
    rest = np.zeros(1)
    for n in near[1:]:
        rest = (rest[:, None] + n[0]).ravel()
    first = np.sort(near[0][0])
    return np.array([int((len(first) - np.searchsorted(first, o - rest, "right")).sum()) for o in own], np.int64)


def on_sphere(x: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """Unit vectors with one more component, whose angles order rows of one `longest` as inner products with a query (None) do."""
    if longest is None:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
        return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
    x = x / longest[:, None]
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    """The length of a vector, taken over its longest component, so that no square overflows or vanishes."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate(F.transform(vector, lambda x: x.cast("double") / most), F.lit(0.0), lambda s, x: s + x * x)
    return F.least(most * F.sqrt(squares), F.lit(1.7e308))


def _hashes(vectors: DataFrame, query: bool, tables: int) -> DataFrame:
    """(class_id, vector, band, part, axes, nearest): a row for each vector, table and part of its buckets that the vector's buckets lie in; nearest: whether its first bucket lies there.

    Buckets are dealt to parts by ranges of their numbers, so that a query's nearest, which share an axis, meet in few parts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shape, own in pdf.groupby(["size", "rows", "probes"]):
                size, rows, probes = map(int, shape)
                x = on_sphere(np.stack(own["vector"].to_numpy()).astype(np.float64), None if query else own["longest"].to_numpy())
                kept = polytopes(rows, x.shape[1])
                buckets = math.prod(2 * dims for dims in kept)
                parts = min(buckets, -(-rows // BLOCK))
                for t in range(tables):
                    codes = nearest_buckets(x, t, kept, min(probes, buckets))
                    first, codes = codes[:, 0] * parts // buckets, np.sort(codes, axis=1)
                    part = codes * parts // buckets
                    starts = np.hstack([np.ones((len(x), 1), bool), part[:, 1:] != part[:, :-1]])
                    row, column = np.nonzero(starts)
                    runs = np.split(codes.ravel(), (row * codes.shape[1] + column)[1:])
                    yield pd.DataFrame({"class_id": own["class_id"].to_numpy()[row], "vector": own["vector"].to_numpy()[row], "band": own["band"].to_numpy()[row], "part": ((size * tables + t) << 32) + part[row, column], "axes": runs, "nearest": part[row, column] == first[row]})

    return vectors.select("class_id", "vector", "band", "longest", "size", "rows", "probes").mapInPandas(run, f"class_id long, vector {vectors.schema['vector'].dataType.simpleString()}, band int, part long, axes array<long>, nearest boolean")


def fit_probes(sample: DataFrame, near: DataFrame, banded: DataFrame, tables: int, share: float = RECALL) -> DataFrame:
    """(size, probes): how many buckets of each table the sample's queries must visit to meet `share` of their nearest (query, class_id)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby("query"):
                x = on_sphere(np.stack(own["vector"].to_numpy()).astype(np.float64), own["longest"].to_numpy())
                q = on_sphere(np.stack(own["asks"].iloc[:1].to_numpy()).astype(np.float64), None)
                kept = polytopes(int(own["rows"].iloc[0]), x.shape[1])
                yield pd.DataFrame({"size": own["size"], "rank": np.min([bucket_ranks(q, x, t, kept) for t in range(tables)], axis=0)})

    asks = sample.select(F.col("class_id").alias("query"), F.col("vector").alias("asks"))
    pairs = near.where("query <> class_id").join(small_side(cut(asks)), "query").join(banded.select("class_id", "vector", "longest", "size", "rows"), "class_id")
    ranks = pairs.repartition("query").mapInPandas(run, "size int, rank long")
    return ranks.groupBy("size").agg((F.ceil(F.percentile("rank", share)) + 1).cast("long").alias("probes"))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds its k nearest others found, by inner product.

    Every usable row is indexed and a query's own row is left out; see `usable` for rows that take no part, and rows of
    another length than the query's aren't compared. Ties go to the smaller vec_id; with fewer candidates than k all
    come. Components of float vectors are kept as they are, all others are taken in double precision. Vectors are hashed
    by bands of norms that differ by a factor of two at most, each scaled by its own longest, and a query probes all
    bands. A query that so meets fewer than k others is searched exactly. Equal vectors are one class and are searched
    once: a class enters with its k + 1 smallest ids, which is all that any result can hold.

    A table joins as many polytopes as make one bucket for FILL vectors of a length, so that buckets keep their size however
    many vectors there are. How many of a table's buckets a query visits is `probes` or else what SAMPLE queries of each
    length, searched exactly, need to meet RECALL of their nearest: few in clustered vectors, many where all are about
    equally far. A table's buckets are dealt to a part for every BLOCK vectors. A part's vectors are split by hashes of class
    ids into blocks of about BLOCK, and the queries that probe some bucket of the part into groups of about as many; each
    block meets each group in a task of its own, so that neither side is gathered whole. A query meets the vectors of the
    buckets that it probes, and each block gives it its best only: at first in the part of its nearest bucket in each table,
    then in its other parts, where only what scores as much as the worst of the best so far is kept. Scores are computed again from the original vectors.

    Ids should be unique: rows that repeat an id are taken as vectors of their own and each is left out of the queries
    with that id. A null id takes no part, an empty table has no result, and other columns are not read, whatever
    their names.
    """
    kind = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.max("query").alias("query"), F.least(F.count("*"), F.lit(k + 1)).alias("copies"))
    classes = classes.withColumn("norm", norm(F.col("vector"))).withColumn("size", F.size("vector"))
    classes = cut(classes.withColumn("band", F.round(F.log2("norm")).cast("int")))
    longest = classes.groupBy("size", "band").agg(F.max("norm").alias("longest"), F.count("*").alias("rows"))  # at most some 280 bands of a size
    banded = classes.join(small_side(cut(longest.withColumn("rows", F.sum("rows").over(Window.partitionBy("size"))))), ["size", "band"])
    order = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).join(classes.select("vector", "class_id"), "vector").select("class_id", "vec_id")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "class_id": [], "score": []})
        right = right.assign(axis=right["axes"].str[0]).sort_values("axis")
        x, ids, axis = np.stack(right["vector"].to_numpy()).astype(np.float64), right["class_id"].to_numpy(), right["axis"].to_numpy()
        known, first = np.unique(axis, return_index=True)
        found = [slice(low, high) for low, high in zip(first.tolist(), [*first[1:].tolist(), len(axis)], strict=True)]
        keep, out = min(k + 1 + SPARE, len(x)), []
        for at in range(0, len(left), 512):
            part = left.iloc[at : at + 512]
            q, probed = np.stack(part["vector"].to_numpy()).astype(np.float64), np.concatenate(part["axes"].to_list())
            order = np.argsort(probed, kind="stable")
            asks = np.repeat(np.arange(len(q)), part["axes"].map(len))[order]
            ends = np.stack([np.searchsorted(probed[order], known, side) for side in ("left", "right")], axis=1)
            score = np.full((len(q), len(x)), -np.inf)
            for (low, high), own in zip(ends.tolist(), found, strict=True):
                if low < high:
                    score[asks[low:high], own] = q[asks[low:high]] @ x[own].T
            top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            best = pd.DataFrame({"query": np.repeat(part["class_id"].to_numpy(), keep), "class_id": ids[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})
            out.append(best[(best["score"] > -np.inf) & (best["score"] >= np.repeat(part["least"].to_numpy(), keep))])
        return pd.concat(out)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
        return found.groupBy("query", "class_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1 + SPARE).drop("r")

    def search_blocks(queries: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
        """(query, class_id, score): the best of each query of all blocks of the parts that it goes to, none under its `least` score."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
        asked = queries.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("axes")) / ASKED)).cast("int").alias("groups"))
        shape = small_side(cut(sizes.join(asked, "part")))
        index = index.join(shape, ["part", "band"]).withColumn("block", dealt("blocks")).withColumn("group", every("groups")).drop("blocks", "groups")
        queries = queries.drop("band").join(shape, "part").withColumn("group", dealt("groups")).withColumn("block", every("blocks")).drop("blocks", "groups")
        queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # both sides may come from the same frames
        keys = ["part", "band", "block", "group"]
        return best(queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(search, "query long, class_id long, score double"))

    def blocks_of(index: DataFrame) -> DataFrame:
        return cut(index.groupBy("part", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))

    def search_all(queries: DataFrame) -> DataFrame:
        return search_blocks(whole.join(small_side(queries.select("class_id")), "class_id", "left_semi").withColumn("least", any_score), whole, blocks_of(whole))

    any_score = F.lit(float("-inf"))
    whole = classes.select("class_id", "vector", F.lit(0).alias("band"), F.col("size").cast("long").alias("part"), F.array(F.lit(0).cast("long")).alias("axes"))
    asking = banded.where("query")
    if probes is None:
        picked = Window.partitionBy("size").orderBy(F.xxhash64("class_id"))
        sample = cut(asking.withColumn("r", F.row_number().over(picked)).where(F.col("r") <= SAMPLE).select("class_id", "vector"))
        near = cut(search_all(sample))
        asking = asking.join(small_side(cut(fit_probes(sample, near, banded, tables))), "size", "left").fillna(1, ["probes"])
    else:
        asking = asking.withColumn("probes", F.lit(probes))
    own = classes.where("query").select(F.col("class_id").alias("query"), "class_id")
    asked, index = cut(_hashes(asking, True, tables)), _hashes(banded.withColumn("probes", F.lit(1)), False, tables).drop("nearest")
    sizes = blocks_of(index)
    first = cut(search_blocks(asked.where("nearest").withColumn("least", any_score), index, sizes))
    least = first.groupBy("query").agg(F.when(F.count("*") > k + SPARE, F.min("score")).alias("least")).withColumnRenamed("query", "class_id")
    others = asked.where("not nearest").join(least, "class_id", "left").withColumn("least", F.coalesce("least", any_score))
    found = best(first.union(search_blocks(others, index, sizes))).select("query", "class_id")
    found = cut(found.union(own).distinct())
    met = found.join(classes.select("class_id", "copies"), "class_id").groupBy("query").agg(F.sum("copies").alias("met")).where(F.col("met") <= k)
    few = cut(met.select(F.col("query").alias("class_id")))
    if not few.isEmpty():
        found = found.union(search_all(few).select("query", "class_id")).distinct()
    theirs, mine = classes.select("class_id", F.col("vector").alias("theirs")), classes.select(F.col("class_id").alias("query"), F.col("vector").alias("mine"))
    exact = found.join(theirs, "class_id").join(mine, "query").select("query", "class_id", inner_product(F.col("mine"), F.col("theirs")).alias("score"))
    per_class = exact.join(members, "class_id").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    asked = rows.where("query").join(classes.where("query").select("vector", F.col("class_id").alias("query_class")), "vector").select(F.col("vec_id").alias("query_id"), "query_class")
    lists = per_class.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    own = asked.join(lists, asked["query_class"] == lists["query"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
