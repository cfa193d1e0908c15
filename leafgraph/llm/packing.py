"""Packing documents into token sequences by shortest-pack-first over the length histogram (Krell et al., 2021)."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm.batches import id_and_text
from leafgraph.llm.bpe import PATTERN, RankArrayBPE, load
from leafgraph.operators.numbering import number_within
from leafgraph.session import cut

#: Pieces to each salt at least: so many of one length one task numbers.
SALTED = 1_000_000
_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """A compiled encoder over the vocabulary file; its ids are those of the tokenizers library, in a fifth of the time."""
    if path not in _loaded:
        vocabulary = RankArrayBPE(path)
        ranks = {raw: i for i, raw in enumerate(vocabulary.bytes_of) if i not in vocabulary.added.values()}
        _loaded[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.added)
    return _loaded[path]


def encode(path: str, text: str) -> bytes:
    """A text's ids as little-endian 32-bit numbers. The compiled encoder refuses very long runs of white space; such a text goes to op2's."""
    try:
        return encoding(path).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
    except ValueError:
        slow = load(path)
        out = slow.encode_many([text])[0]
        slow.words, slow.spaced = {}, {}  # words of millions of characters aren't kept
        return out


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """Packing patterns with their counts: (lengths, how many sequences look like this).

    Lengths are placed longest first, each into the shortest pack that it fits, which is the open pattern with the most
    room; where none has room, a new one is opened and takes the next of this length too, being the shortest now. What is
    done at once for all packs of a pattern is what would be done for one after the other. The work depends on `most` and
    the number of distinct lengths, not on the number of documents.
    """
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    widest: list[int] = []  # rooms of open patterns, negative, as a heap; a room may stand there more than once

    def put(room: int, pattern: list[int], count: int) -> None:
        if count:
            by_room[room].append((pattern, count))
            heapq.heappush(widest, -room)

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo > 0:
            while widest and not by_room.get(-widest[0]):
                heapq.heappop(widest)
            room = -widest[0] if widest else 0
            if room < length:
                # New packs: each is the shortest until it has no room for this length any more.
                per = most // length
                put(most - per * length, [length] * per, todo // per)
                put(most - todo % per * length, [length] * (todo % per), 1 if todo % per else 0)
                todo = 0
            else:
                pattern, count = by_room[room].pop()
                took = min(count, todo)
                put(room, pattern, count - took)
                put(room - length, [*pattern, length], took)
                todo -= took
    patterns: Counter = Counter()
    for group in by_room.values():
        for pattern, count in group:
            patterns[tuple(pattern)] += count
    return [(list(p), n) for p, n in sorted(patterns.items(), reverse=True)]


def slot_table(spark: SparkSession, histogram: dict[int, int], most: int) -> DataFrame:
    """(length, starts, ends, bases, offsets): for each length its runs of slots, by rank. At most `most` rows."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    filled: Counter = Counter()
    base = 0
    for pattern, count in shortest_pack_first(histogram, most):
        offset = 0
        for length in pattern:
            runs[length].append((filled[length], filled[length] + count, base, offset))
            filled[length] += count
            offset += length
        base += count
    schema = "length long, runs array<struct<first:long,past:long,base:long,offset:long>>"
    return spark.createDataFrame([(length, r) for length, r in runs.items()], schema)


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, most: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens and an end token, cut after every `most` tokens: (doc_id, start, length, ids_crc32, doc_tokens[, ids]).

    A null or empty text has its end token only. Repeated rows are documents of their own. No shuffle; nothing else is
    read from docs, so that other columns may have any names.
    """
    end = struct.pack("<I", end_id)

    def run(batches):
        for batch in batches:
            rows = [encode(path, t or "") + end for t in batch.column(1).to_pylist()]
            step = 4 * most
            cuts = [(i, at, row[at : at + step]) for i, row in enumerate(rows) for at in range(0, len(row), step)]
            index = pa.array([i for i, _, _ in cuts], pa.int64())
            out = [
                batch.column(0).take(index), pa.array([at // 4 for _, at, _ in cuts], pa.int64()), pa.array([len(x) // 4 for _, _, x in cuts], pa.int64()),
                pa.array([zlib.crc32(x) for _, _, x in cuts], pa.int64()), pa.array([len(rows[i]) // 4 for i, _, _ in cuts], pa.int64()),
            ]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for _, _, x in cuts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    source = id_and_text(docs, id_col, text_col)
    schema = f"doc_id {source.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset: no piece is split, each sequence holds at most `most` tokens without a gap.

    pieces needs doc_id, start and length (1 to `most`); every other column stays, except sequence_id and offset. Only
    the histogram of lengths, `most` rows at most, comes to the driver. A piece's rank among those of its length comes
    from counts by length and salt, so that a length that many pieces share is spread over many tasks; the pattern's
    slot for that rank is looked up in a table of at most `most` rows. Repeated rows get a slot each. No pieces give none.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces.drop("sequence_id", "offset"))
    salts = max(64, -(-pieces.count() // SALTED))
    ranked = cut(number_within(pieces, ["length"], ["doc_id", "start"], "__rank", salts=salts))
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(spark, histogram, most)
    run = F.element_at(F.filter("runs", lambda r: (F.col("__rank") >= r["first"]) & (F.col("__rank") < r["past"])), 1)
    placed = ranked.join(F.broadcast(slots), "length").withColumn("__run", run)
    return placed.select(*ranked.drop("__rank").columns, (F.col("__run.base") + F.col("__rank") - F.col("__run.first")).alias("sequence_id"), F.col("__run.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, most: int = 2048, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places: (doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset)."""
    return pack_pieces(token_pieces(docs, path, end_id, most, with_ids, id_col, text_col), most)
