"""Document fingerprints by one-permutation MinHash with optimal densification (Shrivastava, 2017) and b-bit codes (Li and König, 2010)."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm.batches import id_and_text
from leafgraph.llm.shingles import ShingleHasher, mix

#: Bins of a fingerprint and bits kept of each; words of a shingle. BINS * BITS / 4 hex digits are stored.
BINS, BITS, WORDS = 256, 4, 5


def probe_table(bins: int) -> np.ndarray:
    """For each empty bin the order in which the others are asked; the same for all documents, so equal sets agree."""
    rng = np.random.default_rng(20170808)
    return np.array([rng.permutation(bins) for _ in range(bins)], np.int16)


def one_permutation(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """A value for each bin: the least hash that fell there, or that of the first non-empty bin in the empty bin's probe order."""
    bins = len(probes)
    shift = np.uint64(64 - bins.bit_length() + 1)
    h = np.sort(hashes)
    where = (h >> shift).astype(np.int64)
    first = np.searchsorted(where, np.arange(bins))
    inside = np.minimum(first, len(h) - 1)
    full = where[inside] == np.arange(bins)
    if not full.all():
        empty = np.flatnonzero(~full)
        lender = probes[empty, full[probes[empty]].argmax(axis=1)]
        inside[empty] = inside[lender]
    return h[inside]


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """The low-order bits of each bin's value, packed. A value is mixed with its bin's number first, so that different values that are lent to several bins agree by chance in each of these by itself."""
    low = (mix(values ^ np.arange(len(values), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes()


def bin_codes(fingerprint: bytes, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(fingerprint, np.uint8)).reshape(-1, bits)
    return flat @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share of equal codes, less what chance alone makes equal (1 in 2^bits), within 0 and 1.

    An empty fingerprint stands for a text without words: it is like itself only.
    """
    if not a or not b:
        return float(a == b)
    chance = 1 / (1 << bits)
    same = float((bin_codes(a, bits) == bin_codes(b, bits)).mean())
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> None:
        if bins & (bins - 1) or bins * bits % 8:
            raise ValueError("bins: a power of two; bins * bits: whole bytes")
        self.shingles, self.probes, self.bits = ShingleHasher(words), probe_table(bins), bits

    def of(self, text: str | None) -> bytes:
        hashes = self.shingles.hashes(text)
        return pack_bits(one_permutation(hashes, self.probes), self.bits) if len(hashes) else b""


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the packed fingerprint of each whole text's word shingles, as hex.

    Words are runs of non-space characters, lower-cased; a text of fewer than `words` words is one shingle. A null text
    counts as empty, and a text without words has the empty fingerprint. Equal texts have equal fingerprints. No shuffle.
    """
    def run(batches):
        make = Fingerprinter(bins, bits, words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make.of(t).hex() for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    source = id_and_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, fingerprint string")


def range_of(ids: np.ndarray, missing: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each id, 0 for the largest ids; bounds ascend, and a missing id lies in the last range."""
    return np.where(missing, len(bounds), len(bounds) - np.searchsorted(bounds, ids, "right"))


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text) in descending order of doc_id; after the last row comes the first.

    Texts come as UTF-8 under zstd, which halves what the shuffle writes; null counts as empty. Rows are dealt by ranges
    of doc_id whose bounds are approximate quantiles (`parts` numbers at most, four for each shuffle partition if not
    given). Only the first rows of a range are dealt twice, to their own range and to the one before, so the texts are
    shuffled once and each task orders its own ranges. Equal ids are ordered by packed text; a null id comes after all
    others.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that uneven hashes of ranges average out
    source = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = source.select("doc_id")
    found = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    bounds = np.unique(np.array(found or [], np.int64))

    def ranges(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range_of(*ids_of(batch.column(0)), bounds), pa.int32())], ["doc_id", "part"])

    heads = ids.mapInArrow(ranges, "doc_id long, part int").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    before = {h["head"]: heads[i - 1]["part"] for i, h in enumerate(heads)}

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            part = range_of(*ids_of(batch.column(0)), bounds)
            guests = [(i, before[x]) for i, x in enumerate(batch.column(0).to_pylist()) if x in before]
            row = np.array([*range(batch.num_rows), *(i for i, _ in guests)], np.int64)
            text = pa.array([pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), text.take(pa.array(row)), pa.array([*part.tolist(), *(to for _, to in guests)], pa.int32()), pa.array(np.arange(len(row)) >= batch.num_rows)], ["doc_id", "text", "to", "guest"])

    dealt = source.mapInArrow(deal, "doc_id long, text binary, to int, guest boolean")
    order = Window.partitionBy("to").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not guest").select("doc_id", "text", "next_text")


def fingerprint_with_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's, in descending order of doc_id, the first document following the last. Null texts count as
    empty. See fingerprint and with_next_text for words, ties and order.
    """
    def run(batches):
        make = Fingerprinter(bins, bits, words)
        for batch in batches:
            out, unpack = [], zstandard.ZstdDecompressor().decompress
            for text, after in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, after = unpack(text).decode(), unpack(after).decode()
                half = len(text) // 2
                edited = text[: len(text) - half] + after[:half]
                mine, other, following = make.of(text), make.of(edited), make.of(after)
                out.append((len(text), sha256(edited.encode()).hexdigest(), mine.hex(), other.hex(), likeness(mine, other, bits), likeness(mine, following, bits)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return with_next_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
