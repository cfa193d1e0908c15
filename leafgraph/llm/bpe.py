"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A short word's parts and the ranks of adjacent ones lie in small arrays; the least rank is found by a scan, the boundary
behind it is deleted, and the two neighbouring ranks are looked up again. New words of one length are merged side by
side, a row of the arrays each. Words longer than SHORT bytes, where scans would cost the square of the length, go
through a heap that gives the same merges. What a word gives is kept, and so is what a chunk between two spaces gives;
both caches are bounded.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.batches import id_and_text

#: Bytes of a word up to which it is merged in an array; words kept per worker, after which the caches start anew.
SHORT, CACHED = 96, 250_000
#: Words of one length from which on they are merged side by side.
ROWS = 16
NONE = 1 << 40
#: How byte-level vocabularies of this kind cut a text into words (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """One vocabulary file of the tokenizers library (byte-level BPE, no normalizer, added tokens matched as they stand)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and model.get("type", "BPE") == "BPE"
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        letters, vocab = byte_letters(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.id_of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.size = size
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank_of = {vocab[a] * size + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.new_of_rank = [vocab[a + b] for a, b in merges]
        order = np.argsort(np.fromiter(self.rank_of, np.int64, len(self.rank_of)))
        self.pairs = np.append(np.fromiter(self.rank_of, np.int64, len(order))[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.rank_of.values(), np.int64, len(order))[order], NONE)
        self.byte_ids, self.merged = np.array(self.id_of_byte, np.int64), np.array(self.new_of_rank, np.int64)
        added = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.special = re.compile(f"({added})") if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def merge_short(self, word: bytes) -> list[int]:
        """ids of a short word: bounds[i] is where part i starts, ranks[i] the rank of parts i and i + 1."""
        ids = [self.id_of_byte[b] for b in word]
        size, rank_of = self.size, self.rank_of
        bounds = list(range(len(ids) + 1))
        ranks = [rank_of.get(a * size + b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            i = ranks.index(rank)
            ids[i] = self.new_of_rank[rank]
            del bounds[i + 1], ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of.get(ids[i] * size + ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank_of.get(ids[i - 1] * size + ids[i], NONE)
        return ids

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NONE where they don't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """What merge_short gives for each of these words of one length, packed; every round deletes one boundary in each word that has a merge left."""
        out: list[bytes] = [b""] * len(words)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks, who = self.ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(words))
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(at)), at]
                done = least == NONE
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                packed, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, own in enumerate(who[done].tolist()):
                    out[own] = packed[i * step : (i + 1) * step]
                if done.all():
                    return out
                ids, ranks, who, at, least = ids[~done], ranks[~done], who[~done], at[~done], least[~done]
            row, column = np.arange(len(at)), np.arange(ids.shape[1] - 1)
            ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[row, at] = self.merged[least]
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            behind, before = at < ranks.shape[1], at > 0
            r, c = row[behind], at[behind]
            ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
            r, c = row[before], at[before]
            ranks[r, c - 1] = self.ranks(ids[r, c - 1], ids[r, c])

    def merge_long(self, word: bytes) -> list[int]:
        ids = [self.id_of_byte[b] for b in word]
        n, size, rank_of = len(ids), self.size, self.rank_of
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank_of[key], i, ids[i], ids[i + 1]) for i in range(n - 1) if (key := ids[i] * size + ids[i + 1]) in rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = self.new_of_rank[rank], False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for left, right in ((prev[i], i), (i, nxt[i])):
                if left >= 0 and right < n and (key := ids[left] * size + ids[right]) in rank_of:
                    heapq.heappush(heap, (rank_of[key], left, ids[left], ids[right]))
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def learn(self, new: Iterable[str]) -> None:
        """Puts the ids of these words in the cache."""
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in new:
            by_length[len(w.encode())].append(w)
        for length, words in by_length.items():
            if length <= SHORT and len(words) >= ROWS:
                self.words.update(zip(words, self.merge_rows([w.encode() for w in words]), strict=True))
            else:
                for w in words:
                    ids = self.merge_short(w.encode()) if length <= SHORT else self.merge_long(w.encode())
                    self.words[w] = struct.pack(f"<{len(ids)}I", *ids)

    def _of_pieces(self, pieces: list[str]) -> bytes:
        words = self.words
        if new := [w for w in dict.fromkeys(pieces) if w not in words]:
            self.learn(new)
        return b"".join(map(words.__getitem__, pieces))

    def _plain(self, text: str) -> bytes:
        """Text without added tokens. Where no space follows a space, every space starts a word, so chunks between spaces are looked up."""
        if "  " in text or text.endswith(" "):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def whole(self, text: str) -> bytes:
        return self._of_pieces(self.pieces(text))

    def learn_chunks(self, unseen: set[str]) -> None:
        """Puts the ids of a space and each of these chunks in the cache. A chunk of letters alone is one word with its space."""
        words = self.words
        whole = [c for c in unseen if c.isalpha()]
        pieces = [(c, self.pieces(" " + c)) for c in unseen.difference(whole)]
        self.learn({*(" " + c for c in whole), *(w for _, own in pieces for w in own)}.difference(words))
        self.spaced.update((c, words[" " + c]) for c in whole)
        self.spaced.update((c, b"".join([words[w] for w in own])) for c, own in pieces)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.words) + len(self.spaced) > 2 * CACHED:
            self.words, self.spaced = {}, {}
        parts = [self.special.split(t) if self.special and any(s in t for s in self.added) else [t] for t in texts]
        unseen: set[str] = set()
        for own in parts:
            for p in own[::2]:
                unseen.update(p.split(" ")[1:])
        unseen.difference_update(self.spaced.keys() & unseen)
        if unseen:
            self.learn_chunks(unseen)
        return [self._plain(own[0]) if len(own) == 1 else b"".join(self.added[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(own)) for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, RankArrayBPE] = {}


def load(path: str) -> RankArrayBPE:
    """The vocabulary, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = RankArrayBPE(path)
    return _loaded[path]


def text_groups(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in order, null as empty, in runs of about `most` characters."""
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_column(texts: list[str | None], path: str) -> list[bytes]:
    bpe = load(path)
    return [ids for run in text_groups(texts) for ids in bpe.encode_many(run)]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as the tokenizers library gives them without special tokens added.

    A null or empty text has no ids. Added tokens found in a text are matched first, as that library does. Repeated rows
    stay; other columns are left behind, whatever their names; an empty table gives an empty one. No shuffle.
    """
    def run(batches):
        for batch in batches:
            rows = encode_column(batch.column(1).to_pylist(), path)
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    source = id_and_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of every list of ids, special tokens kept, broken UTF-8 replaced; null ids give null."""
    def run(batches):
        for batch in batches:
            bpe = load(path)
            text = [None if ids is None else bpe.decode(np.asarray(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes): digests of each text's ids and of what they decode to, in one pass.

    Rows, nulls and empty texts as in bpe_encode: an empty text has no tokens and the digests of no bytes.
    """
    from hashlib import sha256

    def run(batches):
        for batch in batches:
            bpe = load(path)
            rows = encode_column(batch.column(1).to_pylist(), path)
            plain = [bpe.decode(np.frombuffer(r, "<u4")).encode() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([sha256(r).hexdigest() for r in rows]), pa.array([sha256(p).hexdigest() for p in plain]), pa.array([len(p) for p in plain], pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    source = id_and_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
