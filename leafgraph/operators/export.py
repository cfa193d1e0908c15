"""Export bundles: file names, manifests and index pages of all graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.texts import bundle_name, escape_html, export_file_name, number_text, truncate_label
from leafgraph.operators.ingest import on_disk
from leafgraph.operators.layout import NODE_HEIGHT, edge_geometry, layout_bounds

#: Characters of a block of a page.
BLOCK = 1_000_000
#: Width of a node, space around the drawing, and colors of the page (fixed values).
NODE_WIDTH, PAD = 144, 64
ACTIVE, PLAIN, TEXT, MISSING, LINE = "#2f6fed", "#d0d3d9", "#1f2328", "#d64541", "#6b7280"


def export_manifest(members: DataFrame, files: DataFrame, inventory: DataFrame) -> DataFrame:
    """(graph_id, node_count, names, total_bytes) over the members of each graph that are on disk."""
    disk = on_disk(inventory).withColumnRenamed("path", "full_path")
    present = members.join(files.withColumnRenamed("id", "file_id"), "file_id").join(disk, "full_path")
    return present.groupBy("graph_id").agg(F.count("*").alias("node_count"), F.array_sort(F.collect_list(export_file_name(F.col("file_id"), F.col("title")))).alias("names"), F.sum("length").alias("total_bytes"))


def index_pieces(nodes: DataFrame, edges: DataFrame, layout: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(graph_id, part, a, b, kind, html): the pieces of each graph's index page; in the order of part, a, b, kind they are the page.

    A piece is a document's entry, an edge's line, a node's box or what stands around these, so that none is larger than
    a title makes it. See export_index for what a page holds.
    """
    node_id, none = F.col("id"), F.lit(0).cast("long")
    named = nodes.withColumn("name", export_file_name(node_id, F.col("title"))).withColumn("label", F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("#"), node_id.cast("string"))).otherwise(F.col("title")))
    if active is not None:
        named = named.join(active, "graph_id", "left").withColumn("is_active", F.coalesce(F.col("active_id") == node_id, F.lit(False)))
    else:
        named = named.withColumn("is_active", F.lit(False))
    item = F.when(F.col("missing"), F.concat(F.lit('<li><span class="missing">'), escape_html(F.col("title")), F.lit(" (missing)</span></li>"))).otherwise(F.concat(F.lit('<li><a href="'), F.col("name"), F.lit('">'), escape_html(F.col("label")), F.lit("</a></li>")))
    j = named.join(layout.select("graph_id", F.col("file_id").alias("id"), "x", "y"), ["graph_id", "id"], "left")
    label = escape_html(truncate_label(F.col("title"), node_id))
    box = F.concat(
        F.lit('<g transform="translate('), number_text(F.col("x") - NODE_WIDTH / 2), F.lit(" "), number_text(F.col("y") - NODE_HEIGHT / 2), F.lit(f')"><rect width="{NODE_WIDTH}" height="{NODE_HEIGHT}" rx="8" ry="8" fill="#ffffff" stroke="'),
        F.when(F.col("is_active"), ACTIVE).otherwise(PLAIN), F.lit(f'"/><text x="{NODE_WIDTH // 2}" y="{NODE_HEIGHT // 2}" text-anchor="middle" fill="'), F.when(F.col("missing"), MISSING).otherwise(TEXT), F.lit('">'), label, F.lit("</text></g>"),
    )
    drawn = F.when(F.col("missing"), box).otherwise(F.concat(F.lit('<a href="'), F.col("name"), F.lit('" target="_top">'), box, F.lit("</a>")))
    piece = lambda part, html, x=none, y=none, kind=F.lit(""): F.struct(F.lit(part).alias("part"), x.alias("a"), y.alias("b"), kind.alias("kind"), html.alias("html"))
    own = j.select("graph_id", F.explode(F.array(piece(1, item, node_id), piece(5, F.when(F.col("x").isNotNull(), drawn), node_id))).alias("p"))

    stroke = F.when(F.col("kind") == "reference", ' marker-end="url(#arr)"').otherwise(' stroke-dasharray="5 4"')
    path = F.concat(F.lit('<path d="'), F.col("path"), F.lit(f'" fill="none" stroke="{LINE}" stroke-width="1.6"'), stroke, F.lit("/>"))
    lines = edge_geometry(edges, layout).join(nodes.select("graph_id").distinct(), "graph_id", "left_semi").select("graph_id", piece(3, path, F.col("from_id"), F.col("to_id"), F.col("kind")).alias("p"))

    titles = named.groupBy("graph_id").agg(F.max(F.when(F.col("is_active"), F.col("title"))).alias("title"))
    around = titles.join(layout_bounds(layout), "graph_id", "left")
    low_x, low_y = F.coalesce("min_x", F.lit(0.0)) - (NODE_WIDTH / 2 + PAD), F.coalesce("min_y", F.lit(0.0)) - (NODE_HEIGHT / 2 + PAD)
    wide, high = F.coalesce("max_x", F.lit(0.0)) + (NODE_WIDTH / 2 + PAD) - low_x, F.coalesce("max_y", F.lit(0.0)) + (NODE_HEIGHT / 2 + PAD) - low_y
    view = F.concat_ws(" ", number_text(low_x), number_text(low_y), number_text(wide), number_text(high))
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), view, F.lit(f'"><defs><marker id="arr" viewBox="0 0 10 10" refX="9" refY="5" markerWidth="7" markerHeight="7" orient="auto"><path d="M0 0 L10 5 L0 10 z" fill="{LINE}"/></marker></defs><g>'))
    title = escape_html(F.coalesce("title", F.lit("Graph")))
    style = "</title><style>body{font:15px/1.5 sans-serif;max-width:1000px;margin:24px auto}.missing{color:" + MISSING + "}</style></head><body><h1>"
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"/><title>'), title, F.lit(" — graph export" + style), title, F.lit(" — relations graph</h1><h2>Documents</h2><ul class=\"refs\">"))
    frame = [piece(0, head), piece(2, F.concat(F.lit('</ul><h2>Graph</h2><div class="graph">'), svg)), piece(4, F.lit("</g><g>")), piece(6, F.lit("</g></svg></div></body></html>"))]
    return own.unionByName(lines).unionByName(around.select("graph_id", F.explode(F.array(*frame)).alias("p"))).select("graph_id", "p.*")


def export_index(nodes: DataFrame, edges: DataFrame, layout: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(graph_id, html): an index page for each graph of nodes (graph_id, id, title, missing), a row each.

    It lists the documents and draws the graph; present documents link to their export names, missing ones are marked.
    active (graph_id, active_id) gives the page's title, else it is Graph. Everything is put in order by id. Where a page
    may be too large for a row, write page_blocks of its pieces.
    """
    pieces = index_pieces(nodes, edges, layout, active)
    listed = pieces.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "kind", F.coalesce("html", F.lit("")).alias("html")))).alias("p"))
    return listed.select("graph_id", F.array_join(F.transform("p", lambda x: x["html"]), "").alias("html"))


def page_blocks(pieces: DataFrame, size: int = BLOCK) -> DataFrame:
    """(graph_id, part, a, b, kind, html): pieces of pages put together to blocks of about `size` characters, named by their first piece.

    In the order of their names the blocks of a graph are its page. Pieces are dealt by ranges of graph and place and
    stream through sorted partitions, so that a page of any size is written by several tasks and never held whole.
    """
    order = ["graph_id", "part", "a", "b", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, texts, length = None, [], 0
        for batch in batches:
            out = []
            for *key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name and (key[0] != name[0] or length >= size):
                    out.append((*name, "".join(texts)))
                    name = None
                if not name:
                    name, texts, length = key, [], 0
                texts.append(html)
                length += len(html)
            yield blocks(out)
        if name:
            yield blocks([(*name, "".join(texts))])

    def blocks(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*order, "html"])

    whole = pieces.where("html is not null").select(*order, "html")
    return whole.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "graph_id long, part int, a long, b long, kind string, html string")


def export_bundles(members: DataFrame, files: DataFrame, content: DataFrame, index: DataFrame, created: Column) -> DataFrame:
    """(graph_id, bundle, file_name, text): each graph's present documents under export names, and its index.html.

    Write it with sources.bundles.write_export_bundles.
    """
    docs = members.join(files.withColumnRenamed("id", "file_id"), "file_id").join(content, "file_id")
    rows = docs.select("graph_id", export_file_name(F.col("file_id"), F.col("title")).alias("file_name"), "text")
    rows = rows.unionByName(index.join(rows.select("graph_id").distinct(), "graph_id", "left_semi").select("graph_id", F.lit("index.html").alias("file_name"), F.col("html").alias("text")))
    return rows.select("graph_id", bundle_name(created).alias("bundle"), "file_name", "text")
