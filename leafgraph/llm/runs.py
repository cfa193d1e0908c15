"""Periodic runs in texts, found online: catchers over completed dyadic blocks report squares, which merge into runs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafgraph.llm.batches import id_and_text
from leafgraph.llm.shingles import mix

#: Least periods and words of a run that is reported; words appended at a time; bytes of a batch of results at most (about).
PERIODS, WORDS, APPENDED, BYTES = 4, 6, 8_192, 32_000_000


class SquareCatcher:
    """Squares (a stretch of words that stands twice in a row) of a text to which words are appended.

    A block of L = 2**k words that begins at a multiple of L is complete once its last word is there; its catcher then
    looks for the block's words again, 2L to 4L words later, so each appended word is watched by two catchers a level
    (blocks of one word also watch the word right behind them). A square of period p in [2L, 4L) holds such a block in
    its first half, so no square is missed. Where a catcher meets its block again, the stretch over which words p apart are
    equal is measured to both sides, through hashes of all dyadic windows; if it reaches the last word, it stays open and
    the words that follow advance it. A stretch of p words or more is a square, and all squares of one stretch are one
    run. Blocks and their echoes inside one run of a smaller period are passed over: its own catcher has told of it.
    Results don't depend on how the words are dealt to appends. Time is O(n log n), a logarithm more where very many
    blocks come again.
    """

    def __init__(self, seed: int = 0) -> None:
        self.n, self.seed = 0, np.uint64(seed)
        self.windows: list[np.ndarray] = []  # level k: hashes of the 2**k words from each place on, in arrays with room to grow
        none = np.empty(0, np.int64)
        self.found = [none] * 3  # period, first and last place (exclusive) of stretches that have ended and hold a square
        self.open = [none] * 2  # period and first place of stretches that reach the last word

    def _put(self, level: int, at: int, values: np.ndarray) -> None:
        if level == len(self.windows):
            self.windows.append(np.empty(max(64, len(values)), np.uint64))
        if at + len(values) > len(self.windows[level]):
            grown = np.empty(2 * (at + len(values)), np.uint64)
            grown[:at] = self.windows[level][:at]
            self.windows[level] = grown
        self.windows[level][at : at + len(values)] = values

    def _onward(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words from low on equal those from high on."""
        length = np.zeros(len(low), np.int64)
        for k in range(self.n.bit_length() - 1, -1, -1):
            fits = np.flatnonzero(high + length + (1 << k) <= self.n)
            same = self.windows[k][(low + length)[fits]] == self.windows[k][(high + length)[fits]]
            length[fits[same]] += 1 << k
        return length

    def _backward(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words right before low equal those right before high."""
        length = np.zeros(len(low), np.int64)
        for k in range(self.n.bit_length() - 1, -1, -1):
            fits = np.flatnonzero(low - length - (1 << k) >= 0)
            same = self.windows[k][(low - length)[fits] - (1 << k)] == self.windows[k][(high - length)[fits] - (1 << k)]
            length[fits[same]] += 1 << k
        return length

    def _keep(self, period: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        ended = (last < self.n) & (last - first >= period)
        if ended.any():
            self.found = [np.concatenate([a, b[ended]]) for a, b in zip(self.found, (period, first, last), strict=True)]
        going = last == self.n
        if going.any():
            both = np.unique(np.stack([np.concatenate([a, b[going]]) for a, b in zip(self.open, (period, first), strict=True)]), axis=1)
            self.open = [both[0], both[1]]

    def _squares(self) -> list[np.ndarray]:
        """(period, first, last) of all stretches so far that hold a square."""
        period, first = self.open
        whole = self.n - first >= period
        return [np.concatenate([a, b]) for a, b in zip(self.found, (period[whole], first[whole], np.full(int(whole.sum()), self.n)), strict=True)]

    def append(self, words: np.ndarray) -> None:
        """Words as non-negative integers, equal for equal words."""
        if not len(words):
            return
        old, self.n = self.n, self.n + len(words)
        self._put(0, old, mix(words.astype(np.uint64) + np.uint64(1) + self.seed * np.uint64(0x9E3779B97F4A7C15)))
        level = 1
        while (1 << level) <= self.n:
            half, start = 1 << (level - 1), max(0, old - (1 << level) + 1)
            below, stop = self.windows[level - 1], self.n - 2 * half + 1
            self._put(level, start, mix(below[start:stop] * np.uint64(0xD6E8FEB86659FD93) + below[start + half : stop + half]))
            level += 1
        period, first = self.open
        if len(period):
            self.open = [period[:0], first[:0]]
            self._keep(period, first, old + self._onward(old - period, np.full(len(period), old)))
        for period in (1, 2, 3):
            self._near(period, old)
        for level in range(1, len(self.windows)):
            size = 1 << level
            if 3 * size > self.n:
                break
            echoes = np.arange(max(2 * size, old - size + 1), self.n - size + 1)
            hashes, row = self.windows[level], echoes >> level
            for back in (2, 3):
                low = (row - back) << level
                skip = int(np.searchsorted(low, 0))  # echoes too near to the text's beginning
                hit = skip + np.flatnonzero(hashes[low[skip:]] == hashes[echoes[skip:]])
                if len(hit):
                    self._meet(level, low[hit], echoes[hit])

    def _near(self, period: int, old: int) -> None:
        """What the catchers of single words do: stretches of so small a period that begin among the words from old on."""
        at = max(period, old)
        words = self.windows[0]
        same = np.zeros(max(0, self.n - at) + 2, bool)
        same[1:-1] = words[at - period : self.n - period] == words[at : self.n] if at < self.n else False
        edges = at + np.flatnonzero(same[1:] != same[:-1])
        first, last = edges[::2], edges[1::2]
        if len(first) and first[0] == at > period and words[at - 1 - period] == words[at - 1]:
            first, last = first[1:], last[1:]  # it goes on from earlier words and was advanced already
        kept = (last - first >= period) | (last == self.n)
        if kept.any():
            self._keep(np.full(int(kept.sum()), period), first[kept], last[kept])

    def _meet(self, level: int, block: np.ndarray, echo: np.ndarray) -> None:
        """What the catchers of blocks of 2**level words do where they meet them again."""
        size, half = 1 << level, 1 << (level - 1)
        # A square is as long as two blocks at least, so the stretch goes on for half a block to one side, unless its end isn't known.
        before, after, fits = np.maximum(block - half, 0), np.minimum(echo + size, self.n - half), echo + size + half <= self.n
        halves = self.windows[level - 1]
        on = ~fits | (halves[after] == halves[after - echo + block])
        on |= (block >= half) & (halves[before] == halves[before + echo - block])
        block, echo = block[on], echo[on]
        if not len(block):
            return
        period, first, last = self._squares()
        known = (period <= half) & (last - first + period >= size)
        if known.any():
            starts, ends = (first - period)[known], last[known]
            order = np.lexsort((ends, starts))
            starts, ends = starts[order], ends[order]

            def run_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                i = np.maximum(np.searchsorted(starts, at, "right") - 1, 0)
                return starts[i], ends[i], (starts[i] <= at) & (ends[i] >= at + size)

            (start_a, end_a, in_a), (start_b, end_b, in_b) = run_of(block), run_of(echo)
            inside = in_a & (end_a >= echo + size)
            # Of two runs that are apart only the shifts that make their ends meet can give a square; the last run's end isn't known yet.
            apart = in_a & in_b & (start_b > end_a) & (end_b < self.n) & (start_a + echo - block != start_b) & (end_a + echo - block != end_b)
            block, echo = block[~inside & ~apart], echo[~inside & ~apart]
        if len(block):
            self._keep(echo - block, echo - self._backward(block, echo), echo + size + self._onward(block + size, echo + size))

    def runs(self, periods: int = 2, words: int = 2) -> np.ndarray:
        """(start, length, period) of all maximal runs of at least so many periods and words, by start, then period."""
        period, first, last = self._squares()
        start, length = first - period, last - first + period
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        primitive = np.ones(len(start), bool)  # a stretch told of under a multiple of its period has the same ends
        primitive[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        kept = primitive & (length >= np.maximum(words, periods * period))
        found = np.stack([start[kept], length[kept], period[kept]], axis=1)
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: list, periods: int = PERIODS, least: int = WORDS, appended: int = APPENDED) -> np.ndarray:
    """(start, length, period) of the runs of a list of words, checked word by word; a clash of hashes is met by other hashes."""
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return np.empty((0, 3), np.int64)
    for seed in count():
        catcher = SquareCatcher(seed)
        for low in range(0, len(ids), appended):
            catcher.append(ids[low : low + appended])
        found = catcher.runs(periods, least)
        if all((ids[s + q : s + n] == ids[s : s + n - q]).all() for s, n, q in found.tolist()):
            return found


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, periods: int = PERIODS, least: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start,length,period>>, collapsed) of each row of docs.

    Words are what stands between ASCII white space ([^\\x20\\x09-\\x0D]+), numbered from 0. A run is a stretch of words with
    smallest period q, at least `periods` * q and `least` words long, that no neighbouring word extends; runs come by start, then
    period. collapsed: the text without what runs repeat, words joined by one space. A null or empty text has no words: no
    runs, an empty collapsed text. Rows with equal or null ids are rows of their own; other columns aren't read; an empty
    table gives none. Nothing is shuffled; a text takes some 8 bytes a word and level, of which there are log2 of its words.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = batch.column(0), [], 0
            start = 0
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                found = runs_of(words, periods, least)
                rows.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()], collapsed(words, found)))
                held += len(text or b"") + 100 * len(found)
                if held > BYTES:
                    yield out(ids.slice(start, len(rows)), rows)
                    start, rows, held = i + 1, [], 0
            if rows:
                yield out(ids.slice(start, len(rows)), rows)

    def out(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n, runs, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    source = id_and_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
