"""A corpus pipeline of four stages: language ID, near-duplicate removal, surrogates for personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm import langid, ngram_join, packing, pii
from leafgraph.llm.queries import KEY, VOCABULARY, table
from leafgraph.session import cut, release, small_side

#: How far the score of a document's language must lie from chance (0: 1 in K languages) to certainty (1); under it the language counts as unclear.
CLEAR = 0.2


#: Name of the key that tells rows apart whose doc_id is null or repeated.
ROW = "__row"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, written once to the shared folder so that every pass sees the same."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with lang set to it; texts that are null, have no letter or are mostly of words that no learned language supports go."""
    model = langid.fit(docs)
    found = langid.keep_clear(docs, model, CLEAR)
    return found.select(*[F.col(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the least doc_id, null last; among rows that share it, one of them."""
    rows = keyed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    classes = ngram_join.jaccard_join(rows.select(order.alias("key"), "text"), id_col="key")
    gone = small_side(cut(classes.where("doc_id <> class_id").select(F.col(f"doc_id.{ROW}").alias(ROW))))
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their text and n_chars set anew."""
    found = pii.pseudonymize(docs, KEY)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, VOCABULARY, with_ids=False)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", ngram_jaccard), ("PII", surrogates), ("packing", packed)]
#: Language models, MinHash and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each one's result written as Parquet and read again by the next, then deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    return docs
