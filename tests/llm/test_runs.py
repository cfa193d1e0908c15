"""Periodic runs against plain versions."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from leafgraph.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, periods=2, least=2):
    """All maximal runs by looking at every period."""
    found, w = {}, np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.empty(0, int)
    for p in range(1, len(w) // 2 + 1):
        same = np.r_[False, w[p:] == w[:-p], False]
        for a, b in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            if b - a >= p:
                found.setdefault((a, b - a + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items() if n >= max(least, periods * p)), key=lambda r: (r[0], r[2]))


def texts():
    rng = np.random.default_rng(12)
    fibonacci = [[0], [0, 1]]
    for _ in range(8):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield from ([], [1], [1, 1], [1, 2, 1, 2], [0] * 100, fibonacci[-1], fibonacci[-1][5:] + [7] + fibonacci[-1])
    for _ in range(120):
        n, k = int(rng.integers(1, 150)), int(rng.integers(1, 4))
        yield rng.integers(0, k, n).tolist()
        yield np.tile(rng.integers(0, k, int(rng.integers(1, 12))), 12)[:n].tolist()
        yield np.concatenate([np.tile(rng.integers(0, 2, int(rng.integers(1, 5))), int(rng.integers(1, 9))) for _ in range(6)]).tolist()
        line = rng.integers(0, 2, 2)
        yield np.concatenate([[*np.tile(line, 5), 9 + i % 2] for i in range(10)]).tolist()


@pytest.mark.parametrize("step", [1, 3, 64, 10_000])
def test_squares_merge_into_runs_however_words_are_appended(step):
    for words in texts():
        catcher = runs.SquareCatcher()
        for low in range(0, len(words), step):
            catcher.append(np.array(words[low : low + step]))
        assert [tuple(r) for r in catcher.runs().tolist()] == brute(words), words


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 4, 6)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    digest = lambda t: sha256(t.encode()).hexdigest()
    numbers = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_the_query_equals_brute_force(spark, tmp_path, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 15000").select("doc_id", "text")
    more = [(i, " ".join(["a", "b", "c"][: 1 + i % 3] * (4 + i % 5)) + " \u0085x y z y z y z\x0by z") for i in range(1000, 1100)]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).union(odd.where("doc_id <> 7 or doc_id is null").select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_runs(spark, str(tmp_path)).select(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain(*r) for r in docs.collect()), key=repr)
    assert runs.periodic_runs(nothing).isEmpty()


def test_long_and_repetitive_texts(spark, odd):
    row = runs.periodic_runs(odd.where("doc_id = 7")).first()
    assert row["n_words"] == 30_000 and [tuple(r) for r in row["runs"]] == [(0, 30_000, 1)] and row["collapsed"] == "word"
    words = [w for i in range(400) for w in [*["a", "b"] * 250, str(i)]]  # 400 runs, between which nothing repeats
    assert runs.runs_of(words).tolist() == [[501 * i, 500, 2] for i in range(400)]


def test_large_results_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(runs, "BYTES", 10)
    docs = spark.createDataFrame([(i, "x " * i) for i in range(20)], "doc_id long, text string").coalesce(1)
    assert [(r["doc_id"], r["n_words"], r["collapsed"]) for r in runs.periodic_runs(docs).collect()] == [(i, i, "x" if i > 5 else "x " * (i - 1) + "x" * (i > 0)) for i in range(20)]
