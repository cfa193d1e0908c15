"""Reading what is on disk: listings and whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.sources.listing import ENDINGS, PARTITIONS, opened, scan

#: Documents that a task opens; bytes of texts from which on a batch ends.
SHARE, HELD = 10_000, 16_000_000


def scan_inventory(spark: SparkSession, root: str, kind: str = "md", recursive: bool = False) -> DataFrame:
    """(path, length, modification_time) of the files of a kind in a directory, files of no bytes too; contents are not read."""
    return scan(spark, root, kind, recursive)


def read_content(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """(file_id, text, missing) of catalog rows (id, full_path), from the Markdown files anywhere below root.

    Whole texts, without a byte order mark; a document that isn't there has a null text and missing true. Documents are opened
    by the paths that scan_inventory gives, in tasks, and nothing is listed; a path that a listing doesn't give is missing.
    """
    _, top, scheme = opened(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = opened(root)[0]
        for batch in batches:
            ids, texts, size = [], [], 0
            for file_id, path in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                ids.append(file_id)
                texts.append(content(store, path.removeprefix(scheme)) if path and path.startswith(scheme) and is_listed(path.removeprefix(scheme), top) else None)
                size += len(texts[-1] or b"")
                if size >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(texts, pa.binary())], ["file_id", "content"])
                    ids, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(texts, pa.binary())], ["file_id", "content"])

    count = files.count()
    wanted = files.select("id", "full_path").repartition(min(max(1, count), max(PARTITIONS, -(-count // SHARE))))
    found = wanted.mapInArrow(run, f"file_id {files.schema['id'].dataType.simpleString()}, content binary")
    return found.select("file_id", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text"), F.col("content").isNull().alias("missing"))


def is_listed(path: str, top: str) -> bool:
    """Whether a listing of everything below top would give this path if it is a file."""
    inner = path.removeprefix(top.rstrip("/") + "/").split("/")
    return path.startswith(top.rstrip("/") + "/") and path.lower().endswith(ENDINGS["md"]) and not any(p in ("", ".", "..") for p in inner) and not any(p.startswith(".") for p in inner[:-1])


def content(store: fs.FileSystem, path: str) -> bytes | None:
    """All of a file, null if there is none or it may not be read."""
    try:
        with store.open_input_file(path) as file:
            return file.read()
    except (FileNotFoundError, IsADirectoryError, NotADirectoryError, PermissionError):
        return None
