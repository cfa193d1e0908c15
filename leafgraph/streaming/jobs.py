"""Structured Streaming jobs; each gives what its batch twin gives over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafgraph.operators.ingest import ingest
from leafgraph.operators.patches import last_touch
from leafgraph.operators.relations import normalize_relations
from leafgraph.session import cut
from leafgraph.sources import listing
from leafgraph.streaming.store import GraphStore


def stream_ingest(spark: SparkSession, root: str, checkpoint: str, load: Callable[[], DataFrame], add: Callable[[DataFrame], None], recursive: bool = False) -> StreamingQuery:
    """Watches a directory and adds Markdown files that aren't managed, empty ones too.

    load gives the catalog's files as they are, add appends new rows. Each batch is the directory as it then is, so a
    file counts whenever it came and whatever its time is, and a batch that is run again, after a loss, finds its rows
    managed and adds nothing.
    """
    def batch(df: DataFrame, _: int) -> None:
        new = cut(ingest(df.select("path", "length"), load()))
        if not new.isEmpty():
            add(new)

    return listing.stream(spark, root, "md", recursive).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_last_touch(touches: DataFrame) -> DataFrame:
    """(file_id, last_opened, last_written) of a stream (ts, file_id, kind), for output mode update or complete.

    A maximum needs no watermark: a late row can't lower it. The state holds a row for each document.
    """
    return last_touch(touches)


def stream_links(links: DataFrame, files: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Merges a stream of link requests (doc_id, other_id, ui_kind) into the graphs of a store; a batch costs what it touches.

    Edges that exist change nothing, and a batch is published whole or not at all, so one that is run again after a loss
    gives what it would have given.
    """

    def batch(df: DataFrame, _: int) -> None:
        store.merge(normalize_relations(df, files).where("reason is null and kind <> 'companion'").select("from_id", "to_id", "kind"))

    return links.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
