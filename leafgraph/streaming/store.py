"""Graphs kept on disk in buckets, so that a batch of links reads and writes only what it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators.graphs import ATTACHMENTS, COLOR_MAPS, COMPANIONS, EDGES, GRAPHS, MEMBERS, State, merge_links
from leafgraph.operators.relations import joining_edges
from leafgraph.session import cut, delete
from leafgraph.sources.catalog import last_published, publish

#: Folders of a bucket's homes from which on they are put together to one; times that a batch is merged anew because another writer was faster.
FOLDERS, ATTEMPTS = 16, 20
SCHEMAS = {"graphs": GRAPHS, "members": MEMBERS, "edges": EDGES, "companions": COMPANIONS, "color_maps": COLOR_MAPS, "attachments": ATTACHMENTS}
#: Tables to which a merge adds no rows.
MOVED = ("companions", "color_maps", "attachments")
#: The graph that a document came to be in with a version; the last one holds.
HOMES = "file_id long, graph_id long, version long"


class GraphStore:
    """The tables of a State below root: each in buckets by graph, and the documents' graphs in buckets by document.

    A version is a list of the folders that hold each bucket. A batch finds its documents' graphs in their buckets, reads
    the buckets of these graphs, merges, writes these buckets anew, adds the homes that changed to theirs, and publishes the
    new list; buckets that it doesn't touch stay where they are. A version is published if no other writer was faster, else the batch
    is merged anew, so a reader sees all of a batch or nothing. Folders that no version names may be deleted.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root
        self.buckets = self._last()[1].get("buckets", buckets)

    def _last(self) -> tuple[int, dict]:
        return last_published(self.spark, self.root)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.buckets)).cast("int")

    def _read(self, version: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        held = version.get("folders", {}).get(table, {})
        folders = [f for b, own in held.items() if buckets is None or int(b) in buckets for f in own]
        schema = SCHEMAS.get(table, HOMES)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, table: str, key: str, folder: str) -> dict[str, str]:
        """Where each bucket of df was written, large ones by several tasks."""
        df.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/{table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return {s.getPath().getName().partition("=")[2]: f"{folder}/{table}/{s.getPath().getName()}" for s in found if s.getPath().getName().startswith("bucket=")}

    def _touched(self, df: DataFrame, key: str) -> list[int]:
        return sorted(r[0] for r in df.select(self._bucket(key).alias("b")).distinct().collect())  # as many as there are buckets at most

    def state(self) -> State:
        """All graphs as of the last version."""
        _, version = self._last()
        return State(*[self._read(version, table) for table in SCHEMAS], version.get("top_id", 0))

    def merge(self, new_edges: DataFrame) -> list[int]:
        """Merges a batch of edges (from_id, to_id, kind) in normal form; the buckets of graphs that were written anew. A batch that is merged again changes nothing."""
        edges = cut(joining_edges(new_edges).select("from_id", "to_id", "kind").distinct())
        ends = cut(edges.select(F.col("from_id").alias("file_id")).union(edges.select("to_id")).distinct())
        for _ in range(ATTEMPTS):
            number, version = self._last()
            known = self._read(version, "homes", self._touched(ends, "file_id")).join(ends, "file_id", "left_semi")
            own = cut(known.groupBy("file_id").agg(F.max_by("graph_id", "version").alias("graph_id")))
            touched = self._touched(own, "graph_id")
            before = State(*[self._read(version, table, touched) for table in SCHEMAS], version.get("top_id", 0))
            after = merge_links(before, edges)
            if after is before:
                return []
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            folders = {table: dict(held) for table, held in version.get("folders", {}).items()}
            for table in SCHEMAS:
                held = folders.setdefault(table, {})
                if table in MOVED and not held.keys() & set(map(str, touched)):
                    continue
                made = self._write(getattr(after, table), table, "graph_id", folder)
                for b in map(str, touched):
                    held.pop(b, None)
                for b, path in made.items():  # a new graph's bucket may be one that wasn't read
                    held[b] = [*held.get(b, []), path]
            moved = after.members.join(before.members, ["file_id", "graph_id"], "left_anti").select("file_id", "graph_id", F.lit(number + 1).cast("long").alias("version"))
            held = folders.setdefault("homes", {})
            for b, path in self._write(moved, "homes", "file_id", folder).items():
                held[b] = [*held.get(b, []), path]
            full = [int(b) for b, own_folders in held.items() if len(own_folders) > FOLDERS]
            if full:
                homes = self._read({"folders": {"homes": held}}, "homes", full)
                last = homes.groupBy("file_id").agg(F.max(F.struct("version", "graph_id")).alias("x")).select("file_id", "x.graph_id", "x.version")
                held |= {b: [path] for b, path in self._write(last, "homes", "file_id", f"{folder}/joined").items()}
            if publish(self.spark, self.root, number + 1, {"buckets": self.buckets, "top_id": after.top_id, "folders": folders}):
                return touched
            delete(self.spark, folder)
        raise RuntimeError(f"other writers were faster {ATTEMPTS} times")
