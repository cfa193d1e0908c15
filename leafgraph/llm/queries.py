"""The registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm import ann, bpe, fingerprints, langid, near_vectors, ngram_join, packing, pii, runs, sharding, trie, urls, warc

#: Vocabulary file of op2 and op8.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Key of the surrogates in op1; a real job takes a secret one.
KEY = "public example key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "odds")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), dict.fromkeys(range(8), 1.0), dict.fromkeys(range(9), 1.0))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by crc32 of its id, goes on from some word in repeats of a stretch of its own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    sized = words.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    taken = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(taken, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("-1000 * best.length div best.period").alias("exponent_milli")
    return best.select("doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"), milli, "runs_sha256", "collapsed_sha256")


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conv_id: the first h turns of conversation conv_id - conv_id % 20, then its own behind its first h; h: crc32 of the id modulo 4."""
    own = trie.turn_paths(turns, "conv_id", "turn", "role", "text")
    first = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("path", 1, 3).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(first, "base", "left").withColumn("h", h)
    taken = F.slice(F.coalesce("first", F.slice("path", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    return both.select("conv_id", F.concat(taken, rest).alias("path"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return trie.prefix_trie(rebuilt_conversations(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_pii, op2_bpe, op3_fingerprints, op4_langid, op5_ann, op6_urls, op7_ngram_join, op8_packing, op9_sharding, op10_warc, op11_near_vectors, op12_runs, op13_conversations)}
SQL: dict[str, str] = {}
