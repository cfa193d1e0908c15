"""Near-duplicate vectors by NN-descent (Dong et al., 2011): a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from warnings import warn

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm.ann import nearest_buckets, on_sphere, padded_size, usable
from leafgraph.operators.components import connected_components
from leafgraph.session import cut, release, small_side

#: Cosine from which two vectors are linked, neighbours that a list holds, links that a list of nothing but links may grow to.
SIMILARITY, NEIGHBOURS, WIDE = 0.9, 8, 64
#: Orders that the first lists come from, axes that an order goes by, rows of a block that is compared at first.
TABLES, AXES, BLOCK = 6, 3, 256
#: Rounds of refinement at most, share of new entries under which they end, candidates that a round gives an entry (links: four times).
ROUNDS, STILL, GIVEN = 4, 0.02, 4
#: Vectors whose links are counted exactly to audit, the share that must have been found, how often orders are added to get there.
AUDITED, RECALL, AGAIN = 1_024, 0.99, 3
#: Rows of a block when vectors with very many links are compared.
DENSE = 256


def units(flat: np.ndarray, rows: int) -> np.ndarray:
    """Unit vectors in double precision from their components one after the other."""
    return on_sphere(flat.astype(np.float64).reshape(rows, -1), None)[:, :-1]


def vector_list(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(all components, offsets) of a column of arrays."""
    column = batch.column(column)
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def best_of(scores: np.ndarray, similarity: float, usual: int, links: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the `usual` best scores of each row, and of up to `links` of them that are links; -inf never counts."""
    most = min(links, scores.shape[1])
    top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    values = np.take_along_axis(scores, top, 1)
    rank = np.argsort(np.argsort(-values, axis=1, kind="stable"), axis=1, kind="stable")
    rows, at = np.nonzero((values > -np.inf) & ((rank < usual) | (values >= similarity)))
    return rows, top[rows, at]


PAIR = "node long, near long, score double"


def pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "near", "score"])


def first_lists(classes: DataFrame, tables: range, similarity: float) -> DataFrame:
    """(node, near, score): the best neighbours of each vector within a block of each of some orders.

    An order sorts vectors by the signed axes that they are nearest to under pseudo-rotations, one after the other, so
    near vectors mostly stand close together; it is dealt by ranges and cut to blocks of BLOCK rows.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = vector_list(batch, 1)
            sizes, ids = np.diff(offsets), batch.column(0)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = on_sphere(np.stack([flat[offsets[i] : offsets[i + 1]] for i in own]).astype(np.float64), None)
                for t in tables:
                    axes = np.hstack([nearest_buckets(x, 1_000 + t * AXES + i, [padded_size(x.shape[1])], 1) for i in range(AXES)]).astype(">u2")
                    keys = pa.array([bytes(a) for a in axes], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t), pa.int32()), pa.array(np.full(len(own), size), pa.int32()), keys, ids.take(pa.array(own)), batch.column(1).take(pa.array(own))], ["table", "size", "key", "node", "vector"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            flat, offsets = vector_list(batch, 4)
            order = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            ids, out = batch.column(3).to_numpy(), []
            for i, kind in enumerate(order):
                if kind != now or len(held) == BLOCK:
                    out += block(held)
                    held, now = [], kind
                held.append((ids[i], flat[offsets[i] : offsets[i + 1]]))
            held = [(i, v.copy()) for i, v in held]
            yield pairs(out)
        yield pairs(block(held))

    def block(held: list) -> list:
        if len(held) < 2:
            return []
        ids, x = np.array([h[0] for h in held]), units(np.concatenate([h[1] for h in held]), len(held))
        scores = x @ x.T
        np.fill_diagonal(scores, -np.inf)
        rows, columns = best_of(scores, similarity, NEIGHBOURS, WIDE)
        return [(ids[rows], ids[columns], scores[rows, columns])]

    kind = classes.schema["vector"].dataType.simpleString()
    rows = classes.select("node", "vector").mapInArrow(keyed, f"table int, size int, key binary, node long, vector {kind}")
    order = ["table", "size", "key", F.xxhash64("table", "node"), "node"]  # equal keys in another order in each
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, PAIR)


def kept_lists(entries: DataFrame, similarity: float) -> DataFrame:
    """(node, near, score, fresh): each node's NEIGHBOURS best entries, more of them, up to WIDE, where all of these are links."""
    entries = entries.groupBy("node", "near").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), F.xxhash64("node", "near"))
    ranked = entries.withColumn("r", F.row_number().over(best)).where(F.col("r") <= WIDE)
    return ranked.where((F.col("r") <= NEIGHBOURS) | (F.col("score") >= similarity)).drop("r")


def refined(lists: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Candidates (node, near, score) among the neighbours of each node, to both sides: pairs one of which is new to the list and that beat the node's worst entry."""
    back = lists.select(F.col("near").alias("node"), F.col("node").alias("near"), "fresh")
    some = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("near", "node"))
    back = back.withColumn("r", F.row_number().over(some)).where(F.col("r") <= 2 * NEIGHBOURS).drop("r")
    around = lists.select("node", "near", "fresh").unionByName(back).groupBy("node", "near").agg(F.max("fresh").alias("fresh"))
    n, worst = F.count("*"), F.min("score")
    bounds = lists.groupBy("node").agg(F.when(n < NEIGHBOURS, -2.0).when(worst < similarity, worst).when(n < WIDE, similarity).otherwise(2.0).alias("bound"))  # a full list of links takes nothing more
    vectors = classes.select(F.col("node").alias("near"), "vector").join(bounds.withColumnRenamed("node", "near"), "near", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    rows = around.join(vectors, "near").select("node", "near", "fresh", "bound", "vector").repartition("node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            flat, offsets = vector_list(batch, 4)
            if rest:
                now = [np.concatenate(c) for c in zip(rest[0], now, strict=True)]
                flat, offsets = np.concatenate([rest[1], flat]), np.concatenate([rest[2], rest[2][-1] + offsets[1:]])
            starts = [0, *(np.flatnonzero(np.diff(now[0])) + 1).tolist()]
            yield pairs([p for low, high in zip(starts, starts[1:], strict=False) for p in joined(now, flat, offsets, low, high)])
            low = starts[-1]
            rest = [c[low:].copy() for c in now], flat[offsets[low] :].copy(), offsets[low:] - offsets[low]
        if rest:
            yield pairs(joined(*rest, 0, len(rest[0][0])))

    def joined(now: list, flat: np.ndarray, offsets: np.ndarray, low: int, high: int) -> list:
        ids, fresh, bound = now[1][low:high], now[2][low:high].astype(bool), now[3][low:high]
        if high - low < 2 or not fresh.any():
            return []
        x = units(flat[offsets[low] : offsets[high]], high - low)
        scores = x @ x.T
        np.fill_diagonal(scores, -np.inf)
        scores[(~fresh[:, None] & ~fresh[None, :]) | (scores <= bound[:, None])] = -np.inf
        rows, columns = best_of(scores, similarity, GIVEN, 4 * GIVEN)
        return [(ids[rows], ids[columns], scores[rows, columns])] if len(rows) else []

    return rows.mapInArrow(run, PAIR)


def descend(lists: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The lists after rounds of refinement, which end when few entries are new."""
    for _ in range(ROUNDS):
        new = refined(lists, classes, similarity).withColumn("fresh", F.lit(True))
        before, lists = lists, cut(kept_lists(lists.withColumn("fresh", F.lit(False)).unionByName(new), similarity))
        release(before)
        fresh, all_of = lists.agg(F.count_if("fresh"), F.count("*")).first()
        if fresh <= STILL * all_of:
            break
    return lists


def link_counts(lists: DataFrame, classes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(counts (node, links), edges (a, b)): how many rows each node is linked to, and links that join all that is linked.

    Lists that are full of links may leave some out. Their nodes are compared with their whole component, block by block,
    and only counts leave a pair of blocks; so the number of links is exact in what the components hold.
    """
    linked = lists.where(F.col("score") >= similarity)
    edges = cut(linked.select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct())
    full = cut(linked.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= WIDE).select("node"))
    copies = classes.select(F.col("node").alias("near"), "copies")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
    if full.isEmpty():
        return both.join(copies, "near").groupBy("node").agg(F.sum("copies").alias("links")), edges
    marked = small_side(full.withColumn("full", F.lit(True)))
    plain = both.join(marked, "node", "left_anti").join(small_side(full.select(F.col("node").alias("near"))), "near", "left_anti")
    plain = plain.join(copies, "near").groupBy("node").agg(F.sum("copies").alias("links"))
    components = cut(connected_components(edges, "a", "b").select(F.col("id").alias("node"), "component").join(marked, "node", "left"))
    sizes = components.groupBy("component").agg(F.ceil(F.count_if("full") / DENSE).cast("int").alias("rows"), F.ceil(F.count("*") / DENSE).cast("int").alias("columns")).where("rows > 0")
    members = cut(components.join(small_side(cut(sizes)), "component").join(classes.select("node", "copies", "vector"), "node").withColumn("full", F.coalesce("full", F.lit(False))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    one = members.where("full").withColumn("row", dealt("rows")).withColumn("column", every("columns")).withColumn("side", F.lit(0))
    other = members.withColumn("row", every("rows")).withColumn("column", dealt("columns")).withColumn("side", F.lit(1))
    rows = one.unionByName(other).select("component", "row", "column", "side", "node", "copies", "full", "vector").repartition("component", "row", "column").sortWithinPartitions("component", "row", "column", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            side, ids, copies, full = (batch.column(i).to_pylist() for i in range(3, 7))
            flat, offsets = vector_list(batch, 7)
            for i, key in enumerate(keys):
                if key != now:
                    yield counted(*held)
                    now, held = key, ([], [])
                held[side[i]].append((ids[i], copies[i], full[i], flat[offsets[i] : offsets[i + 1]].copy()))
        yield counted(*held)

    def counted(a: list, b: list) -> pa.RecordBatch:
        nodes, links = [], []
        if a and b:
            ids_a, ids_b, copies_a, copies_b = (np.array([r[i] for r in s]) for i in (0, 1) for s in (a, b))
            hit = units(np.concatenate([r[3] for r in a]), len(a)) @ units(np.concatenate([r[3] for r in b]), len(b)).T >= similarity
            hit &= ids_a[:, None] != ids_b[None, :]
            mine, theirs, some = hit @ copies_b, copies_a @ hit, ~np.array([r[2] for r in b])
            nodes, links = np.concatenate([ids_a, ids_b[some]]), np.concatenate([mine, theirs[some]])
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])

    dense = rows.mapInArrow(run, "node long, links long")
    return plain.unionByName(dense).groupBy("node").agg(F.sum("links").alias("links")), edges


def audit(counts: DataFrame, classes: DataFrame, similarity: float) -> float:
    """The share of the links of AUDITED vectors, chosen by a hash, that were found: they are compared with all vectors."""
    asked = classes.orderBy(F.xxhash64(F.lit("audit"), "node")).limit(AUDITED).select("node", "vector").collect()
    sizes = {len(r["vector"]) for r in asked}
    queries = {s: (np.array([r["node"] for r in asked if len(r["vector"]) == s]), units(np.concatenate([np.array(r["vector"]) for r in asked if len(r["vector"]) == s]), sum(len(r["vector"]) == s for r in asked))) for s in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = vector_list(batch, 2)
            lengths, ids, copies = np.diff(offsets), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            nodes, links = [], []
            for s, (names, q) in queries.items():
                own = np.flatnonzero(lengths == s)
                if len(own):
                    x = units(np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in own]), len(own))
                    hit = (q @ x.T >= similarity) & (names[:, None] != ids[own][None, :])
                    nodes.append(names)
                    links.append(hit @ copies[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (nodes, links)], ["node", "links"])

    true = classes.select("node", "copies", "vector").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    found, all_of = true.join(counts, "node", "left").agg(F.sum(F.least(F.coalesce("links", F.lit(0)), "true")), F.sum("true")).first()
    return (found or 0) / all_of if all_of else 1.0


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors.

    Two vectors are linked if their cosine, in double precision, is at least `similarity`; n_links: the other rows that a
    row is linked to; component_id: the least vec_id that a chain of links reaches; kept: whether that is the row itself.
    Vectors that are null, empty or zero or hold null or non-finite components (`ann.usable`) link with nothing, vectors
    of different lengths don't link. Rows that repeat a vec_id are rows of their own. A row with a null vec_id has no
    links, no component and isn't kept. Other columns aren't read; an empty table gives none.

    Equal vectors are one node. First lists of neighbours come from blocks of TABLES orders. In a round each node compares
    its neighbours, to both sides, with one another, and each of them keeps what is nearer than what it has; a list that
    is full of links grows up to WIDE, and beyond that its node's links are counted exactly in blocks of its component. At
    last AUDITED vectors are compared with all: while less than RECALL of their links were found, orders and rounds are
    added. Only ids, vectors and scores are shuffled, some 3 * NEIGHBOURS vectors for each in a round.
    """
    kind = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("vector")))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("hash", F.xxhash64("vector"))
    classes = cut(good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    lists = cut(kept_lists(first_lists(classes, range(TABLES), similarity).withColumn("fresh", F.lit(True)), similarity))
    lists = descend(lists, classes, similarity)
    for attempt in range(AGAIN + 1):
        counts, edges = link_counts(lists, classes, similarity)
        counts = cut(counts)
        recall = audit(counts, classes, similarity)
        if recall >= RECALL:
            break
        if attempt == AGAIN:
            warn(f"{recall:.3f} of the audited links were found", stacklevel=2)
            break
        more = first_lists(classes, range(TABLES << attempt, TABLES << (attempt + 1)), similarity).withColumn("fresh", F.lit(True))
        lists = descend(cut(kept_lists(lists.withColumn("fresh", F.lit(False)).unionByName(more), similarity)), classes, similarity)
    joined = connected_components(edges, "a", "b").select(F.col("id").alias("node"), "component")
    found = classes.join(counts, "node", "left").join(joined, "node", "left")
    found = cut(found.select("vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    linked = good.join(found, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~(F.col("vec_id").isNotNull() & usable(F.col("vector")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
