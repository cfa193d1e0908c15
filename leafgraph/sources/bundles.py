"""Writing and reading export bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_export_bundles(bundles: DataFrame, path: str) -> None:
    """bundles (graph_id, bundle, file_name, text) as Parquet, many graphs to a file.

    Rows are dealt by ranges of graph and file name and sorted in each file, so that a file's footer tells which graphs it
    holds: a reader of one graph opens the footers and then only that graph's row groups. A graph of any size is dealt to
    as many tasks as its share of the rows.
    """
    order = ["graph_id", "file_name"]
    bundles.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def read_export_bundle(spark: SparkSession, path: str, graph_id: int) -> DataFrame:
    """(bundle, file_name, text) of one graph."""
    return spark.read.parquet(path).where(F.col("graph_id") == graph_id).drop("graph_id")
