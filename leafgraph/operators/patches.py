"""Changes to catalog rows: patches, saved texts, touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.texts import trim_ws
from leafgraph.operators.ingest import on_disk


def fold_patches(patches: DataFrame) -> DataFrame:
    """One patch per id that does what all of them do in order of seq: the last value of each field.

    (id, title, place, sort_order): place is null where no patch moves the file, else struct<folder_id> whose folder_id is
    null for the root; a patch that names a folder and the root means the root.
    """
    root = F.coalesce("move_to_root", F.lit(False))
    place = F.when(root, F.struct(F.lit(None).cast("long").alias("folder_id"))).when(F.col("folder_id").isNotNull(), F.struct(F.col("folder_id").cast("long").alias("folder_id")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    return patches.groupBy("id").agg(last(trim_ws(F.col("title"))).alias("title"), last(place).alias("place"), last(F.col("sort_order")).alias("sort_order"))


def apply_file_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """files after the patches (seq, id, title, folder_id, move_to_root, sort_order); null means unchanged, titles are trimmed."""
    p = fold_patches(patches).withColumnsRenamed({"id": "__id", "title": "__title", "sort_order": "__sort"})
    j = files.join(p, F.col("id") == F.col("__id"), "left")
    new = {"title": F.coalesce("__title", "title"), "folder_id": F.when(F.col("place").isNotNull(), F.col("place.folder_id")).otherwise(F.col("folder_id")), "sort_order": F.coalesce("__sort", "sort_order")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in files.columns])


def content_save_check(saves: DataFrame, files: DataFrame, inventory: DataFrame) -> DataFrame:
    """saves (file_id, ...) with reason: unknown_document, missing (from the disk: a conflict), or null."""
    known = files.select(F.col("id").alias("__id"), "full_path")
    disk = on_disk(inventory).select(F.col("path").alias("__path"))
    j = saves.join(known, F.col("file_id") == F.col("__id"), "left").join(disk, F.col("full_path") == F.col("__path"), "left")
    return j.select(*[saves[c] for c in saves.columns], F.when(F.col("__id").isNull(), "unknown_document").when(F.col("__path").isNull(), "missing").alias("reason"))


def latest_content(saves: DataFrame) -> DataFrame:
    """(file_id, text, last_write) of saves (seq, ts, file_id, text): the last write of each document wins."""
    return saves.groupBy("file_id").agg(F.max_by("text", F.struct("ts", "seq")).alias("text"), F.max("ts").alias("last_write"))


def last_touch(touches: DataFrame) -> DataFrame:
    """(file_id, last_opened, last_written) of touches (ts, file_id, kind): batch twin of the stream."""
    return touches.groupBy("file_id").agg(F.max(F.when(F.col("kind") == "open", F.col("ts"))).alias("last_opened"), F.max(F.when(F.col("kind") == "save", F.col("ts"))).alias("last_written"))
