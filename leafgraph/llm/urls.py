"""URL filters: rules by host and path, else naive Bayes over the words of segmented hosts and paths."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.session import cut, small_side

#: (verdict, host and path) of the rules; the longest that fits wins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Words that the segmenter knows from the start; they are no labels.
WORDS = ["ads", "adult", "bet", "bets", "blog", "casino", "cheap", "escort", "example", "farm", "free", "gambling", "hack", "jackpot", "loan", "mail", "news", "pills", "poker", "porn", "replica", "shop", "spam", "track", "viagra", "warez", "win", "www", "xxx"]
#: Urls that the classifier is fitted on at most (those with the least hashes).
SAMPLE_ROWS = 50_000
#: Letters of a label of a host at most, as DNS has it; a longer run of letters is no word of a host (a fixed value).
LABEL = 63


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, null if none: its host or a subdomain, its path a prefix of the url's."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("verdict"), F.lit("").alias("rule")))
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        own_host, _, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(f"/{rest}")
        out = out.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    return out


def segment(label: str, log_p: dict[str, float], unknown: float) -> list[str]:
    """The most probable split of a label of letters into words; unknown: log-probability of each letter of an unknown word."""
    best, last = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LABEL), end):
            word = label[start:end]
            score = best[start] + log_p.get(word, unknown * (1 + len(word)))
            if score > best[end]:
                best[end], last[end] = score, start
    words: list[str] = []
    end = len(label)
    while end:
        words.append(label[last[end] : end])
        end = last[end]
    return words[::-1]


def host_words(hosts: DataFrame, corpus: DataFrame, text_col: str) -> DataFrame:
    """(host, words) of distinct hosts, split by word counts over the whole of `corpus`.

    Only words that are a substring of some host's label are kept after counting, and each host gets just its own: the
    counts are joined to substrings by shuffles, so neither the corpus' words nor the hosts pass through the driver. The
    last label (com, org) is a word as it stands; digits and hyphens part words and go. The corpus' words are its whole
    runs of Latin letters, of two letters at least; longer ones than a label holds count for the total only.
    """
    counts = cut(corpus.select(F.explode(F.regexp_extract_all(F.lower(F.regexp_replace(F.col(text_col), "<[^>]*>", " ")), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    known = corpus.sparkSession.createDataFrame([(w, 50) for w in WORDS], "word string, n long")
    labels = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("label"))
    starts = labels.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("label"))))
    parts = starts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LABEL), F.length("label") - F.col("i") + 1)), lambda n: F.substr("label", F.col("i"), n))).alias("word")).distinct()
    parts = cut(parts)
    used = counts.join(small_side(cut(parts.select("word").distinct())), "word", "left_semi").unionByName(known).groupBy("word").agg(F.sum("n").alias("n"))
    total = F.lit(float(counts.agg(F.sum("n")).first()[0] or 1))
    vocabulary = parts.join(used, "word").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", F.ln(F.col("n") / total)))).alias("log_p"))
    both = hosts.join(vocabulary, "host", "left").select("host", "log_p", F.ln(1 / total).alias("unknown"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = []
            for host, log_p, unknown in zip(pdf["host"], pdf["log_p"], pdf["unknown"], strict=True):
                log_p = dict(log_p) if log_p is not None else {}
                *labels, last = host.rsplit(".", 1)
                words.append([w for label in labels for run in re.findall("[a-z]+", label) for w in segment(run, log_p, min(unknown, -1.0))] + ([last] if last else []))
            yield pd.DataFrame({"host": pdf["host"], "words": words})

    return both.mapInPandas(run, "host string, words array<string>")


def path_tokens(path: Column) -> Column:
    """Runs of letters of the path, lower-cased; every run of digits is the token #."""
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), lambda t: F.when(t.rlike(r"^\p{N}"), F.lit("#")).otherwise(t))


def fit_bayes(tokens: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Log-odds (block over allow) of each token, of an unknown one ('') and of the prior (' '), from at most about `rows` labelled rows.

    tokens: (id, words, path_words, bad), bad null where there is no label. Multinomial naive Bayes with one added to each
    count; the sample's tokens come to the driver. Without a bad or a good example every token's odds are even and
    nothing is blocked.
    """
    labelled = tokens.where("bad is not null")
    total = labelled.count()
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(1, total)))))
    sizes = {r["bad"]: r["n"] for r in sample.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return {"": 0.0, " ": -1.0}
    counted = sample.select("bad", F.explode(F.concat("words", "path_words")).alias("token")).groupBy("token").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    table = counted.collect()
    bad, good = sum(r["bad"] for r in table) + len(table) + 1, sum(r["good"] for r in table) + len(table) + 1
    odds = {r["token"]: math.log((r["bad"] + 1) / bad) - math.log((r["good"] + 1) / good) for r in table}
    return odds | {"": math.log(1 / bad) - math.log(1 / good), " ": math.log(sizes[True] / sizes[False])}


def url_tokens(pages: DataFrame, rules: list[tuple[str, str]], label: Column | None, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(page_id, host, path, words, path_words, found, bad): each url's tokens, the rule that fits, and what it is an example of: the rule's verdict, else label."""
    url, own = F.col(url_col), F.lit(None).cast("boolean") if label is None else label.cast("boolean")
    rows = cut(pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), own.alias("label")))
    hosts = cut(host_words(rows.select("host").distinct(), pages.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text"))
    joined = rows.join(small_side(hosts), "host").withColumn("path_words", path_tokens(F.col("path"))).withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    return joined.select("page_id", "host", "path", "words", "path_words", "found", F.coalesce(F.col("found.verdict") == "block", "label").alias("bad"))


def with_odds(tokens: DataFrame, odds: dict[str, float]) -> DataFrame:
    """tokens with the summed log-odds of host and path in place of path_words."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = [odds[" "] + sum(odds.get(w, odds[""]) for w in (*a, *b)) for a, b in zip(pdf["words"], pdf["path_words"], strict=True)]
            yield pdf.drop(columns="path_words").assign(odds=sums)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "path_words")
    return tokens.mapInPandas(score, f"{kinds}, odds double")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, label: Column | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, odds, words): each url's rule and verdict, or the classifier's where no rule fits.

    The segmenter's word counts come from text_col of all pages. The classifier is fitted on a bounded sample of the pages'
    own urls: those that a rule fits, with its verdict, and of the others those whose `label` (a condition on pages) is
    true (block) or false (allow). It blocks where the summed log-odds of host and path tokens are above 0; without
    examples of both kinds it allows.

    A url that is null or without :// has an empty host and path, fits no rule and is judged by the prior alone. Repeated
    rows and ties stay: every row is judged by itself; odds of exactly 0 allow. An empty table has no result, other columns
    of pages are not read, whatever their names. Urls are taken whole, however long: a label of n letters costs 63 n
    steps of the segmenter. Hosts are split once each; a host that many rows share is joined back to them by a broadcast
    if the hosts are few, else by a shuffle that AQE can split.
    """
    tokens = url_tokens(pages, RULES if rules is None else rules, label, id_col, url_col, text_col)
    odds = fit_bayes(tokens.select(F.col("page_id").alias("id"), "words", "path_words", "bad"))
    found = tokens.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"), "words", "path_words")
    verdict = F.coalesce("ruled", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return with_odds(found, odds).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "odds", "words")


def held_out_accuracy(pages: DataFrame, rules: list[tuple[str, str]] | None = None, label: Column | None = None, folds: int = 5, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """One row (n, accuracy, most): labelled urls of one fold, the share of them that a classifier fitted on the other folds judges as labelled, and the share of the commoner label.

    Folds are hashes of host and path, so that no url is both learned from and judged.
    """
    tokens = url_tokens(pages, RULES if rules is None else rules, label, id_col, url_col, text_col)
    tokens = tokens.where("bad is not null").withColumn("held", F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == 0)
    odds = fit_bayes(tokens.where("not held").select(F.col("page_id").alias("id"), "words", "path_words", "bad"))
    judged = with_odds(tokens.where("held").select("bad", "words", "path_words"), odds)
    share = F.avg(F.col("bad").cast("double"))
    return judged.agg(F.count("*").alias("n"), F.avg(((F.col("odds") > 0) == F.col("bad")).cast("double")).alias("accuracy"), F.greatest(share, 1 - share).alias("most"))
