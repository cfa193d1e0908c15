"""N-gram Jaccard join: MinHash banding, shuffled on band hashes, with pairs verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.batches import id_and_text
from leafgraph.llm.shingles import ShingleHasher, mix
from leafgraph.operators.components import connected_components
from leafgraph.session import cut, release, small_side

#: Words of a shingle, least similarity, share of the pairs at just this similarity that banding must propose.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.995
#: Distinct texts and shingles of a block at most; pairs are verified block against block. Shingle hashes of a matrix slice.
BLOCK, SHINGLES, COLUMNS = 256, 2_000_000, 8_192
#: Candidates to a task when they are verified.
TASK = 2_000


def bands_for(similarity: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, with which bands * rows <= most_hashes reach the recall."""
    best = None
    for rows in range(1, most_hashes + 1):
        agree = similarity**rows
        bands = 1 if agree >= recall else np.ceil(np.log1p(-recall) / np.log1p(-agree))
        if bands * rows > most_hashes:
            break  # more rows need more bands still
        best = int(bands), rows
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


class Signer:
    """Band hashes of shingle sets; equal in a band with probability similarity ** rows."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(1997)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
        self.offsets = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max)
        for low in range(0, len(shingles), 512):  # a slice of all hashes that stays in the processor's cache
            some = self.factors[:, None] * shingles[None, low : low + 512]
            some += self.offsets[:, None]
            some >>= np.uint64(20)
            np.minimum(least, some.min(axis=1), out=least)
        least = least.reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            out = mix(out ^ least[:, i])
        return out.view(np.int64)


def set_id(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, sid, size, bands) of each row of (doc_id, text, key): the id of its shingle set, the set's size, its band hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, signer = ShingleHasher(words), Signer(bands, rows)
        for batch in batches:
            sets = [np.unique(hasher.hashes(t)) for t in batch.column(1).to_pylist()]
            signed = pa.array([signer.of(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), signed], ["doc_id", "key", "sid", "size", "bands"])

    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, key long, sid binary, size int, bands array<long>")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b: products of 0/1 matrices, a slice of the elements at a time."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [*map(len, a)]), np.repeat(np.arange(len(b)), [*map(len, b)])
    out = np.zeros((len(a), len(b)), np.float32)
    at_a, at_b = np.searchsorted(common, flat_a), np.searchsorted(common, flat_b)
    in_a, in_b = (common[np.minimum(at, len(common) - 1)] == flat if len(common) else np.zeros(len(flat), bool) for at, flat in ((at_a, flat_a), (at_b, flat_b)))
    for low in range(0, len(common), COLUMNS):
        wide = min(COLUMNS, len(common) - low)
        slices = []
        for rows, at, inside, n in ((rows_a, at_a, in_a, len(a)), (rows_b, at_b, in_b, len(b))):
            own = inside & (at >= low) & (at < low + wide)
            m = np.zeros((n, wide), np.float32)
            m[rows[own], at[own] - low] = 1
            slices.append(m)
        out += slices[0] @ slices[1].T
    return out


def linked_groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links the least number (rows first, then columns) that a chain of links leads to."""
    rows, columns = linked.shape
    a, b, none = np.arange(rows), np.arange(columns) + rows, rows + columns
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], none).min(axis=0, initial=none))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], none).min(axis=1, initial=none))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def verify(a: list[tuple], b: list[tuple] | None, similarity: float) -> list[tuple[bytes, bytes, int]]:
    """(sid, peer, links) from the sets (sid, copies, shingles) of two blocks, or of one (b is None).

    links: how many rows of the table a set is linked to; sid and peer: edges that join what is linked. Sets without links
    are left out.
    """
    within, b = b is None, a if b is None else b
    sets_a, sets_b = [x[2] for x in a], [x[2] for x in b]
    shared = shared_counts(sets_a, sets_b)
    sizes_a, sizes_b = np.array([*map(len, sets_a)]), np.array([*map(len, sets_b)])
    linked = shared >= similarity * (sizes_a[:, None] + sizes_b[None, :] - shared) - 1e-9 * sizes_a[:, None]
    if within:
        np.fill_diagonal(linked, False)
    links = [linked @ np.array([x[1] for x in b])]
    group = [linked_groups(linked | np.eye(*linked.shape, dtype=bool))[0]] if within else []
    if not within:
        links.append(linked.T @ np.array([x[1] for x in a]))
        group = [*linked_groups(linked)]
    ids = [x[0] for x in (a if within else [*a, *b])]
    links, group = np.concatenate(links), np.concatenate(group)
    return [(ids[i], ids[group[i]], int(links[i])) for i in np.flatnonzero(links)]


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copies, n_links) for each row of docs.

    Two texts are linked if the Jaccard similarity of their sets of `words`-word shingles is at least `similarity` (words:
    runs of non-space characters, lower-cased; a shorter text is one shingle). class_id is the least doc_id that a chain of
    links reaches, so documents without a link are their own class; copies counts the rows with the same shingles, the row
    itself too; n_links counts the other rows that this one is linked to. Null and empty texts count as copies of each
    other. Rows with a null doc_id belong to their class but don't name it, unless all do. Other columns aren't read.

    Rows with equal sets become one node first. Nodes that share a band hash are candidates. Each node has a home, the
    fullest bucket of any node that it shares a bucket with, and a home's nodes are dealt to blocks of about BLOCK nodes
    and SHINGLES shingles, by size first: only sets whose sizes allow the similarity meet. Two blocks are compared if some bucket has nodes of both,
    so what is compared grows with the candidates and not with what a chain of them joins. A pair of blocks is verified on
    the full sets and gives counts and edges of a spanning forest, never pairs of rows. No candidate is dropped.
    Expected recall: `recall` of the pairs at `similarity`, more above; chains make up for most of the rest in class_id.
    """
    bands, rows = bands_for(similarity, recall)
    source = id_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    signed = cut(signatures(source, words, bands, rows))
    nodes = cut(signed.groupBy("sid").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("holder"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")))

    # Candidates with the buckets that they share. The home of a node is the fullest bucket of any node that it shares a bucket with.
    banded = nodes.select("sid", "size", F.explode("bands").alias("band"))
    buckets = cut(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(banded.join(small_side(buckets), "band").groupBy("sid", "size").agg(F.max(F.struct("n", "band")).alias("fullest"), F.collect_set("band").alias("buckets")))
    spread = met.select("sid", "fullest", F.explode("buckets").alias("band"))
    tops = cut(spread.groupBy("band").agg(F.max("fullest").alias("top")))
    home = spread.join(small_side(tops), "band").groupBy("sid").agg(F.max("top")["band"].alias("home"))
    level = F.floor(F.ln("size") / F.lit(float(-np.log(similarity)))).cast("int")
    settled = cut(met.join(home, "sid").select("sid", "size", "buckets", "home", level.alias("level")))

    # Blocks of homes, and the pairs of blocks that share a bucket, each with a number that deals them to tasks evenly.
    homes = cut(settled.groupBy("home", "level").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SHINGLES)).alias("k")))
    blocked = settled.join(small_side(homes), ["home", "level"]).select("sid", "level", "buckets", F.xxhash64("home", "level", F.pmod(F.xxhash64("sid"), F.col("k"))).alias("block"))
    blocked = cut(blocked)
    places = cut(blocked.select("block", "level", F.explode("buckets").alias("band")).groupBy("band", "block", "level").agg(F.count("*").alias("n")))
    other = places.select("band", F.col("block").alias("with"), F.col("level").alias("level_b"))
    apart = places.join(other, "band").where((F.col("block") < F.col("with")) & (F.abs(F.col("level") - F.col("level_b")) <= 1)).select("block", "with")
    pairs = apart.unionByName(places.where("n > 1").select("block", F.col("block").alias("with"))).distinct()
    number = F.monotonically_increasing_id()
    pairs = cut(pairs.withColumn("number", number.bitwiseAND((1 << 33) - 1) + F.shiftright(number, 33)))
    to = cut(pairs.select("block", "with", "number", F.lit(0).alias("side"), F.col("block").alias("own")).unionByName(pairs.where("block <> with").select("block", "with", "number", F.lit(1).alias("side"), F.col("with").alias("own"))))

    # The sets of the candidates only, made again from the text of one document each, found by its id, null or not, and a hash of the text.
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                made = [np.unique(hasher.hashes(t)) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in made], pa.binary()), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], ["sid", "shingles"])

    candidates = cut(nodes.select("sid", "holder", "copies").join(small_side(blocked.select("sid", "block")), "sid"))
    wanted = small_side(candidates.select(F.col("holder.doc_id").alias("held_id"), F.col("holder.key").alias("held_key")).distinct())
    texts = source.join(wanted, source["doc_id"].eqNullSafe(wanted["held_id"]) & (source["key"] == wanted["held_key"]), "left_semi").select("text").distinct()
    made = texts.mapInArrow(sets, "sid binary, shingles array<long>")
    work = candidates.select("sid", "copies", F.col("block").alias("own")).join(small_side(to), "own").join(made, "sid")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // TASK))
    work = work.select("block", "with", "side", "sid", "copies", "shingles", "number").repartitionById(parts, F.pmod("number", F.lit(parts)).cast("int")).sortWithinPartitions("block", "with", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in in_pairs(batches):
            found = verify(pair[0], pair[1] or None, similarity) if pair[0] else []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["sid", "peer", "links"])

    verified = cut(work.drop("number").mapInArrow(compare, "sid binary, peer binary, links long"))

    release(buckets, met, tops, settled, homes, blocked, places, pairs, to, candidates)

    # Classes: chains of links, each named by its least id.
    links = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    joined = cut(connected_components(verified.where("sid <> peer"), "sid", "peer"))
    linked = nodes.select(F.col("sid").alias("id"), "first").join(small_side(joined), "id")
    names = cut(linked.groupBy("component").agg(F.min("first").alias("class_id")))
    named = cut(joined.join(small_side(names), "component").select(F.col("id").alias("sid"), "class_id").join(links, "sid"))
    classes = nodes.select("sid", "first", "copies").join(small_side(named), "sid", "left")
    classes = cut(classes.select("sid", F.when(F.col("links").isNull(), F.col("first")).otherwise(F.col("class_id")).alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return signed.select("doc_id", "sid").join(small_side(classes), "sid").select("doc_id", "class_id", "copies", "n_links")


def in_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """The two sides of each pair of blocks, as lists of (sid, copies, shingles), from rows sorted by pair."""
    now, sides = None, ([], [])
    for batch in batches:
        a, b, side, sid, copies = (batch.column(i).to_pylist() for i in range(5))
        offsets = batch.column(5).offsets.to_numpy()
        flat = batch.column(5).values.to_numpy()
        for i in range(batch.num_rows):
            if (a[i], b[i]) != now:
                if now:
                    yield sides
                now, sides = (a[i], b[i]), ([], [])
            sides[side[i]].append((sid[i], copies[i], flat[offsets[i] : offsets[i + 1]].copy()))
    if now:
        yield sides
