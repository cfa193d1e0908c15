"""Session helpers shared by every job: the shared folder, tables written there to cut lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Bytes up to which a side may be broadcast, as `width` measures its rows.
BROADCAST_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a new temporary folder serves if Spark runs in one process (tests); on a cluster that raises
    ValueError, since executors don't see each other's disks.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(spark, "_leafgraph_dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafgraph-")
        spark._leafgraph_dir = folder
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path for one job, below this application's own folder in the shared one."""
    return f"{shared_dir(spark)}/leafgraph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; frames that its jobs returned can't be read any more."""
    delete(spark, f"{shared_dir(spark)}/leafgraph-{spark.sparkContext.applicationId}")


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet and read from there ever after.

    It survives lost executors, and what is built on it has a short plan and a true estimate of its size. Columns of the
    result are new ones: address them by name.
    """
    spark, names = df.sparkSession, df.columns
    folder = scratch(spark, "cut")
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    plain.write.parquet(folder)
    out = spark.read.schema(plain.schema).parquet(folder).toDF(*names)
    out._leafgraph_folder = folder
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes the files of frames that `cut` gave, when nothing that is still to be run reads them."""
    for df in frames:
        if df is not None and (folder := getattr(df, "_leafgraph_folder", None)):
            delete(df.sparkSession, folder)


def width(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, StructType):
        return sum((width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 24
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 40
    return F.lit(8)


def shuffled(df: DataFrame) -> DataFrame:
    """df marked to be joined by shuffles, however small Spark takes it to be: for sides that grow with the input, so that the driver gets none of them."""
    return df.hint("merge")


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows take at most `most` bytes, else df, to be joined by shuffles. Give it a frame that is cheap to scan."""
    row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most else df
