"""Consecutive numbers over large tables without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.session import cut, small_side

#: Parts of a group in number_within; the table of counts has at most so many rows for each group.
SALTS = 256


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int = SALTS) -> DataFrame:
    """df with a column `name`: 0, 1, 2, ... within each group of `keys`, gapless.

    Rows are spread over `salts` parts of their group by a hash of the `order` columns; a part's offset is the running sum
    of the counts of the parts before it, and within its part a row is numbered by `order`. So a group of any size is
    numbered by many tasks. The numbering is fixed by the values; rows equal in keys and order get numbers in any order
    among themselves. Null keys are a group. The counts, a row for each key and part, are broadcast if they are few
    and joined by a shuffle if not. df is read twice: cut it first if it is dear to make.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.lit("number"), *order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    numbered = salted.withColumn("__row", F.row_number().over(local))
    same: Column = numbered["__salt"] == offsets["__s"]
    for i, k in enumerate(keys):
        same = same & numbered[k].eqNullSafe(offsets[f"__k{i}"])
    joined = numbered.join(small_side(offsets), same)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__offset") + F.col("__row") - 1).alias(name))


def number_rows(df: DataFrame, order: list[str], name: str, start: Column | int = 1) -> DataFrame:
    """df with a column `name`: start, start + 1, ... over the whole table in the order of the columns `order`.

    Rows are dealt by ranges of the order, which are written once so that both passes see the same; to the driver come
    the ranges' sizes only. The order should be total: rows that are equal in it are numbered in any order. Nulls first.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offset, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, offset))
        offset += sizes[part]
    before = df.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    first = F.lit(start) if isinstance(start, int) else start
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__row", local).join(F.broadcast(before), "__part").select(*df.columns, (first + F.col("__offset") + F.col("__row") - 1).cast("long").alias(name))
