"""Language identification of mixed-language text: script ranges, per-word n-gram scores, Viterbi with a switching penalty."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm.batches import id_and_text, small_batches
from leafgraph.llm.bpe import text_groups
from leafgraph.session import cut, small_side

#: Rows of each language that the model is fitted on at most (those with the least hashes of doc_id).
SAMPLE_ROWS = 2_000
#: What a change of language between two words costs, in nats; characters of an n-gram.
SWITCH, LENGTHS = 6.0, (1, 2, 3)
#: First and last code points of the scripts that narrow a word's candidates (fixed values; what is in none is `other`).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "thai": [(0xE00, 0xE7F)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
#: Runs of letters: the first also takes numerals that aren't digits, which are rare, for letters, and is faster.
QUICK, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Words kept per worker; characters of the texts that go through Viterbi side by side.
CACHED, GROUP = 150_000, 2_000_000
#: Words that are scored at a time.
CHUNK = 10_000


def word_pattern(text: str) -> re.Pattern | regex.Pattern:
    """The pattern whose matches in a text are its runs of letters (Unicode category L), the quick one where it has no numeral."""
    return QUICK if all(map(str.isalpha, QUICK.findall(text))) else LETTERS


def words_of(text: str) -> list[str]:
    words = QUICK.findall(text)
    return words if all(map(str.isalpha, words)) else LETTERS.findall(text)


def _code(gram: str) -> int:
    """An n-gram of at most three characters as one number."""
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


class Model:
    """Languages, the scripts each is written in, and log-probabilities of n-grams."""

    def __init__(self, counts: list[tuple[str, str, int]], scripts: list[tuple[str, str, float]], switch: float = SWITCH) -> None:
        self.languages = sorted({x[0] for x in scripts})
        index = {x: i for i, x in enumerate(self.languages)}
        table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(index)))
        for language, gram, n in counts:
            table[gram][index[language]] += n
        total = np.zeros((max(LENGTHS) + 1, len(index)))
        kinds = np.zeros(max(LENGTHS) + 1)
        for gram, n in table.items():
            total[len(gram)] += n
            kinds[len(gram)] += 1
        self.unseen = [np.log(0.5 / (total[n] + 0.5 * (kinds[n] + 1))) for n in range(len(total))]
        grams = sorted(table, key=_code)
        self.keys = np.array([_code(g) for g in grams], np.int64)
        self.log = np.array([np.log((table[g] + 0.5) / (total[len(g)] + 0.5 * (kinds[len(g)] + 1))) for g in grams]).reshape(len(grams), len(index))
        # A script's candidates: the languages that write at least a twentieth of their words in it.
        names = [*SCRIPTS, "other"]
        self.able = np.array([[any(x[:2] == (lang, s) and x[2] >= 0.05 for x in scripts) for lang in self.languages] for s in names])
        ranges = sorted((a, b, names.index(s)) for s, own in SCRIPTS.items() for a, b in own)
        self.range_start, self.range_end, self.range_script = (np.array(x) for x in zip(*ranges, strict=True))
        self.switch = switch
        self.place: dict[str, int] = {}
        self.known = np.empty((0, len(self.languages)), np.float32)  # scores of the words in `place`
        self.supported = np.empty(0, bool)  # which of them some language supports

    def score_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | language) for each language less that of the best, for all words at once; languages of other scripts are far behind.

        The n-grams of " word " are taken from all words side by side, a space between two of them: an n-gram with a
        space inside belongs to no word. A word is no evidence if no language supports it, which comes second: its script
        is that of no language, or it is that of all and most of the word's pairs of characters occur in none.
        """
        c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
        space = c == 32
        word = np.cumsum(space) - 1
        out = np.zeros((len(words), len(self.languages)))
        for n in LENGTHS:
            code = c[: len(c) - n + 1].copy()
            for i in range(1, n):
                code = code << 21 | c[i : len(c) - n + 1 + i]
            fits = ~space[: len(code)] if n == 1 else np.ones(len(code), bool) if n == 2 else ~space[1 : len(code) + 1]
            code, own = code[fits], word[: len(fits)][fits]
            at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
            met = self.keys[at] == code
            if n == 2:
                seen, pairs = np.bincount(own, met, len(words) + 1)[: len(words)], np.bincount(own, minlength=len(words) + 1)[: len(words)]
            value = np.where(met[:, None], self.log[at], self.unseen[n])
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(own, value[:, k], len(words) + 1)[: len(words)]
        out = out / len(LENGTHS)
        out = np.maximum(out - out.max(axis=1, keepdims=True), -12.0)
        first = c[np.flatnonzero(space)[:-1] + 1]
        at = np.searchsorted(self.range_start, first, "right") - 1
        script = np.where((at >= 0) & (first <= self.range_end[at]), self.range_script[at], len(self.able) - 1)
        able = self.able[script]
        supported = able.any(axis=1) & (~able.all(axis=1) | (2 * seen >= pairs))
        return np.where(supported[:, None], np.where(able, out, -40.0), 0.0), supported

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        if len(self.place) > CACHED:
            self.place.clear()
        place, n = self.place, len(self.place)
        if new := [w for w in dict.fromkeys(words) if w not in place]:
            if n + len(new) > len(self.known):
                more = max(n, 2 * len(new))
                self.known = np.concatenate([self.known[:n], np.empty((more, len(self.languages)), np.float32)])
                self.supported = np.concatenate([self.supported[:n], np.empty(more, bool)])
            for low in range(0, len(new), CHUNK):  # some ten MB of arrays at a time
                some = slice(n + low, n + min(low + CHUNK, len(new)))
                self.known[some], self.supported[some] = self.score_new(new[low : low + CHUNK])
            place.update(zip(new, range(n, n + len(new)), strict=True))
        return self.known[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

    def supports(self, words: list[str]) -> np.ndarray:
        """Whether some language supports each word; for words that were just scored."""
        return self.supported[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best language and the scores of every word of every text: Viterbi over all texts side by side, the longest first; nothing if no language is known."""
        number = np.int8 if len(self.languages) <= 127 else np.int16
        if not self.languages:
            return [(np.empty(0, number), np.empty((0, 0), np.float32))] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        steps, k = int(lengths[0]) if len(lengths) else 0, len(self.languages)
        flat = self.scores([w for i in order for w in texts[i]])
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        live = [int(n) for n in np.searchsorted(-lengths, -np.arange(steps), "left")]  # texts with a word at each step
        back = np.empty((len(flat), k), number)
        stay = np.arange(k, dtype=number)
        best = np.zeros((len(texts), k), np.float32)
        for t in range(steps):
            n = live[t]
            if t:
                now = best[:n]
                top = now.argmax(axis=1).astype(number)
                jump = now[np.arange(n), top][:, None] - self.switch
                moved = jump > now
                back[starts[:n] + t] = np.where(moved, top[:, None], stay)
                best[:n] = np.where(moved, jump, now)
            best[:n] += flat[starts[:n] + t]
        path = np.empty(len(flat), number)
        at = best.argmax(axis=1).astype(number)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            rows = starts[:n] + t
            path[rows] = at[:n]
            if t:
                at[:n] = back[rows, at[:n]]
        out: list = [None] * len(texts)
        for j, i in enumerate(order):
            own = slice(starts[j], starts[j] + lengths[j])
            out[i] = path[own], flat[own]
        return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled documents, at most `rows` whole texts of each language, chosen by a hash of the id.

    Rows with a null text or language are skipped; without any usable row the model knows no language. Words are counted
    in Spark; to the driver come the counts of the n-grams of each language, which the sample bounds, and a row for each
    language and script.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    # A hash of the id orders the rows of a language; those beyond three times the share that is wanted are left out before they are ordered.
    drawn = source.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("draw"))
    sizes = small_side(cut(drawn.groupBy("lang").agg(F.count("*").alias("n"))))
    near = drawn.join(sizes, "lang").where(F.col("draw") * F.col("n") <= F.lit(3.0 * rows * (1 << 30)))
    order = Window.partitionBy("lang").orderBy("draw", "id")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("id", "lang")
    sample = source.join(small_side(cut(chosen.dropDuplicates())), ["id", "lang"])
    found = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    words = cut(found.groupBy("lang", "word").agg(F.count("*").alias("n")))
    # Each word counts by the root of how often it occurs, so that a few texts that repeat one word don't rule the counts.
    padded = words.withColumn("w", F.concat(F.lit(" "), "word", F.lit(" "))).withColumn("n", F.ceil(F.sqrt("n")))
    cut_up = [_grams(F.col("w"), size) for size in LENGTHS]
    counted = padded.select("lang", "n", F.explode(F.concat(*cut_up)).alias("gram")).where("gram <> ' '").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = [(r["lang"], r["gram"], int(r["n"])) for r in counted.collect()]
    scripts = words.groupBy("lang", _script_column(F.col("word")).alias("script")).agg(F.sum("n").alias("n")).collect()
    total: dict[str, int] = defaultdict(int)
    for r in scripts:
        total[r["lang"]] += r["n"]
    return Model(counts, [(r["lang"], r["script"], r["n"] / total[r["lang"]]) for r in scripts], switch)


def _grams(word: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - (size - 1)), lambda i: F.substr(word, i, F.lit(size)))


def _script_column(word: Column) -> Column:
    c = F.substring(word, 1, 1)
    out = F.when(F.lit(False), "")
    for name, ranges in SCRIPTS.items():
        out = out.when(c.rlike("^[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"), name)
    return out.otherwise("other")


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, words[, spans]): each whole text's main language, and the spans of its languages.

    Words are runs of letters, lower-cased. lang_pred has the most letters of all languages that the words are labelled
    with (ties: the first by name), score is its share of the letters times the chance that the summed evidence gives
    it. A null text or one without a letter is `und` with score 0 and no spans, and so is every text under a model that
    knows no language. spans: from the first to past the last
    letter, in code points, of each run of words of one language. Rows stay as they are; no shuffle.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for group in text_groups(batch.column(1).to_pylist(), GROUP):
                found = [[(m.start(), m.end()) for m in word_pattern(t).finditer(t)] for t in group] if spans else None
                words = [words_of(t.lower()) for t in group] if not spans else [[t[a:b].lower() for a, b in own] for t, own in zip(group, found, strict=True)]
                for i, (own, (path, scores)) in enumerate(zip(words, model.label(words), strict=True)):
                    if not own or not model.languages:
                        rows.append(("und", 0.0, len(own), []))
                        continue
                    lang, score = main_of(own, path, scores, model)
                    pieces = []
                    if spans:
                        edges = np.flatnonzero(np.diff(path)) + 1
                        pieces = [{"start": found[i][a][0], "end": found[i][b - 1][1], "lang": model.languages[path[a]]} for a, b in zip([0, *edges], [*edges, len(own)], strict=True)]
                    rows.append((lang, score, len(own), pieces))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = [pa.string(), pa.float64(), pa.int64(), *[pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))] * spans]
    names = ["doc_id", "lang_pred", "score", "words", *["spans"] * spans]
    source = id_and_text(docs, id_col, text_col)
    schema = f"doc_id {source.schema[0].dataType.simpleString()}, lang_pred string, score double, words long" + ", spans array<struct<start:long,end:long,lang:string>>" * spans
    return source.mapInArrow(run, schema)


def keep_clear(docs: DataFrame, model: Model, least: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is found with a clearness of at least `least`, lang_col set to it; all other columns stay.

    See `clearness`. Rows with a null text or without a letter go, and all rows if the model knows no language. No shuffle.
    """
    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = [x for group in text_groups(texts, GROUP) for x in main_languages([words_of(t.lower()) for t in group], model)]
            keep = pa.array([clear >= least and lang != "und" for lang, clear in found], pa.bool_())
            columns = [pa.array([lang for lang, _ in found], pa.string()) if i == lang_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, docs_names).filter(keep)

    small_batches(docs.sparkSession)
    docs_names = docs.columns
    text_at, lang_at = docs_names.index(text_col), docs_names.index(lang_col)
    return docs.mapInArrow(run, docs.schema)


def main_languages(words: list[list[str]], model: Model) -> list[tuple[str, float]]:
    """(language, clearness) of each text, given by its words."""
    out = []
    for own, (path, scores) in zip(words, model.label(words), strict=True):
        out.append(("und", 0.0) if not own or not model.languages else clearness(own, path, scores, model))
    return out


def clearness(words: list[str], path: np.ndarray, scores: np.ndarray, model: Model) -> tuple[str, float]:
    """The main language of the words that some language supports, and how far its score lies from 1 in K languages (0) to certainty (1).

    The least score that a best language can have is 1 in K, so this says the same for any K. It is 0 where words that no
    language supports have most of the letters.
    """
    supported = model.supports(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    if 2 * size[supported].sum() < size.sum():
        return main_of(words, path, scores, model)[0], 0.0
    lang, score = main_of([w for w, good in zip(words, supported, strict=True) if good], path[supported], scores[supported], model)
    chance = 1 / len(model.languages)
    return lang, score if chance == 1 else max(0.0, (score - chance) / (1 - chance))


def main_of(words: list[str], path: np.ndarray, scores: np.ndarray, model: Model) -> tuple[str, float]:
    letters = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(model.languages))
    main = int(letters.argmax())
    evidence = scores[path == main].sum(axis=0, dtype=np.float64)
    chance = 1 / np.exp(np.minimum(evidence - evidence[main], 50)).sum()
    return model.languages[main], float(letters[main] / letters.sum() * chance)


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the labelled documents that aren't held out, applied to all.

    See label_spans for nulls and texts without letters. Without a label every text is `und`; an empty table gives none.
    """
    model = fit(docs.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    labelled = label_spans(docs, model, id_col, text_col, spans=False)
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
