"""The catalog's tables as Parquet, published all or nothing; writers that race lose nothing."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse
from urllib.request import url2pathname

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from leafgraph.session import delete

TABLES = ("folders", "files", "graphs", "members", "edges", "companions", "color_maps", "attachments")
#: Times that a change is made anew because another writer was faster.
ATTEMPTS = 20


def save_catalog(spark: SparkSession, tables: dict[str, DataFrame], root: str, buckets: int | None = None) -> str:
    """Publishes these tables as the next version, whatever the last one holds; returns the version's name.

    A reader sees the version before or this one, never a part. A job that dies leaves an unpublished directory.
    """
    return update_catalog(spark, root, lambda _: tables, buckets)


def update_catalog(spark: SparkSession, root: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], buckets: int | None = None) -> str:
    """Publishes what `change` makes of the last version's tables as the next version; returns its name.

    Tables that change gives back as it got them aren't written again: the new version points to where they are. Numbers of
    versions follow each other, and the pointer to a number is made only if it isn't there yet. Who comes second takes
    away what it wrote, reads the version that was faster and makes its change anew, so no change is lost; after ATTEMPTS
    such defeats RuntimeError is raised. Making a file only if it is absent is one step on local disks and HDFS, and on
    object stores that offer conditional writes.
    """
    for _ in range(ATTEMPTS):
        number, found = last_published(spark, root)
        manifest = found.get("tables", {})
        old = _read(spark, manifest)
        new, version = change(dict(old)), uuid.uuid4().hex
        paths = {}
        for name, df in new.items():
            if name in old and df is old[name]:
                paths[name] = manifest[name]
            else:
                paths[name] = f"{root}/versions/{version}/{name}"
                (df.repartition(buckets, "graph_id") if buckets and "graph_id" in df.columns else df).write.parquet(paths[name])
        if publish(spark, root, number + 1, {"version": version, "tables": paths}):
            return version
        delete(spark, f"{root}/versions/{version}")
    raise RuntimeError(f"other writers were faster {ATTEMPTS} times")


def publish(spark: SparkSession, root: str, number: int, content: dict) -> bool:
    """Makes `content` version `number` below root, unless there is one of that number; whether it did."""
    return _create(spark, f"{root}/published/{number:012d}.json", json.dumps(content))


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file unless it is there; whether it did. It is whole when it comes in sight on a local disk, elsewhere once it is closed."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        own = url2pathname(parsed.path) if parsed.scheme else path
        os.makedirs(os.path.dirname(own), exist_ok=True)
        part = f"{own}.{uuid.uuid4().hex}.part"
        with open(part, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(part, own)  # fails if it is there
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def last_published(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The number and content of the last version that is published whole; (0, {}) if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return 0, {}
    names = sorted((s.getPath().getName() for s in store.listStatus(folder) if s.getPath().getName().endswith(".json")), reverse=True)
    for name in names:
        text = "".join(r[0] for r in spark.read.text(f"{root}/published/{name}", wholetext=True).collect())
        if text:  # an empty one is still being written
            return int(name.split(".")[0]), json.loads(text)
    return 0, {}


def _read(spark: SparkSession, manifest: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in manifest.items()}


def load_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version published last; none if there is none."""
    return _read(spark, last_published(spark, root)[1].get("tables", {}))


def load_legacy(spark: SparkSession, url: str, table: str, driver: str) -> DataFrame:
    """A table of an old database over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver).load()
