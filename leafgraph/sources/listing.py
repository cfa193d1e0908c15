"""Listings of directories as a Spark data source, batch and stream: directories are read in tasks, files of no bytes are kept."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from leafgraph.session import cut

ENDINGS = {"md": (".md", ".markdown"), "json": (".json",), "any": ("",)}
#: Entries that a task lists before it hands back the directories that it hasn't come to; partitions of a listing.
BUDGET, PARTITIONS = 100_000, 64
SCHEMA = "path string, length long, modification_time timestamp"


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path, what stands before a path of it in an address) of an address or a local path."""
    store, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + root)
    return store, path.rstrip("/") or "/", "" if isinstance(store, fs.LocalFileSystem) else root.partition("://")[0] + "://"


def listed(root: str, directories: list[str], kind: str, recursive: bool, budget: int | None = BUDGET) -> tuple[list[tuple[str, int, datetime | None]], list[str]]:
    """(files, directories left) below some directories of root's file system: files of a kind as (path, length, time of the last change).

    Once `budget` entries were listed, directories that weren't are handed back. One that is gone or may not be read
    has no files; those whose name begins with a dot are passed over.
    """
    store, _, scheme = opened(root)
    files, todo, seen = [], deque(directories), 0
    while todo and (budget is None or seen < budget):
        try:
            entries = store.get_file_info(fs.FileSelector(todo.popleft(), allow_not_found=True))
        except (PermissionError, NotADirectoryError):
            continue
        seen += len(entries)
        for entry in entries:
            if entry.type == fs.FileType.Directory:
                if recursive and not entry.base_name.startswith("."):
                    todo.append(entry.path)
            elif entry.type == fs.FileType.File and entry.base_name.lower().endswith(ENDINGS[kind]):
                files.append((scheme + entry.path, entry.size, entry.mtime and entry.mtime.astimezone(timezone.utc)))
    return files, list(todo)


def scan(spark: SparkSession, root: str, kind: str, recursive: bool) -> DataFrame:
    """(path, length, modification_time) of the files of a kind in a directory, or anywhere below it.

    A round lists directories in tasks, each going down until its budget is spent; what is left is dealt to the tasks of the
    next round. So a tree of any shape is spread over tasks, and a small one takes one round.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, left = listed(root, batch.column(0).to_pylist(), kind, recursive)
            rows = [*files, *((path, None, None) for path in left)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.timestamp("us", "UTC"))], ["path", "length", "modification_time"])

    todo, found = spark.createDataFrame([(opened(root)[1],)], "path string"), None
    while True:
        entries = cut(todo.mapInArrow(run, SCHEMA))
        files = entries.where("length is not null")
        found = files if found is None else found.unionByName(files)
        todo = entries.where("length is null").select("path").repartition(PARTITIONS)
        if todo.isEmpty():
            return found


class Part(InputPartition):
    def __init__(self, directories: list[str], recursive: bool) -> None:
        super().__init__(directories)
        self.recursive = recursive


def parts(root: str, kind: str, recursive: bool) -> list[Part]:
    """Directories dealt to partitions: from root downwards until there are enough of them; those above are listed for themselves."""
    store, top, _ = opened(root)
    above, front = [], deque([top])
    while recursive and front and len(front) < PARTITIONS and len(above) < PARTITIONS:
        here = front.popleft()
        above.append(here)
        front += [e.path for e in store.get_file_info(fs.FileSelector(here, allow_not_found=True)) if e.type == fs.FileType.Directory and not e.base_name.startswith(".")]
    return [p for p in [Part(above if recursive else [top], False), *(Part([d], True) for d in front if recursive)] if p.value]


class Listing(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.kind, self.recursive = options["path"], options.get("kind", "md"), options.get("recursive", "false") == "true"

    def partitions(self) -> list[Part]:
        return parts(self.root, self.kind, self.recursive)

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from listed(self.root, partition.value, self.kind, partition.recursive, None)[0]


class ListingStream(DataSourceStreamReader):
    """Each batch is the listing as it is when the batch is read; an offset counts the looks at it. What is known already is the receiver's to tell, as in stream_ingest."""

    def __init__(self, options: dict[str, str]) -> None:
        self.inner, self.looks = Listing(options), None

    def initialOffset(self) -> dict:
        return {"looks": 0}

    def latestOffset(self) -> dict:
        # The time of the look: later than any offset that a run before this one has logged.
        return {"looks": int(datetime.now(timezone.utc).timestamp() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.inner.partitions() if end["looks"] > start["looks"] else []

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.inner.read(partition)

    def commit(self, end: dict) -> None:
        return None


class DirectoryListing(DataSource):
    """Format `listing`: option path, kind (md, json or any) and recursive (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Listing:
        return Listing(dict(self.options))

    def streamReader(self, schema: object) -> ListingStream:
        return ListingStream(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(DirectoryListing)
    return spark


def stream(spark: SparkSession, root: str, kind: str = "md", recursive: bool = False) -> DataFrame:
    """(path, length, modification_time) as a stream: with each trigger the listing as it then is."""
    return registered(spark).readStream.format("listing").option("kind", kind).option("recursive", str(recursive).lower()).load(root).select("path", F.col("length"), "modification_time")
