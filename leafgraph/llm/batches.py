"""How texts are handed to Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most. Texts may be long, and a worker holds a batch several times over while it works.
ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ROWS rows, where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, ROWS)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) and nothing else of docs, for a function over small Arrow batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
