"""Sources, sinks and streams against their batch twins."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafgraph.operators import export, graphs, patches, relations
from leafgraph.sources import bundles, catalog, inventory, listing
from leafgraph.streaming import jobs, store


def test_scan_and_content(spark, tmp_path):
    (tmp_path / "sub" / ".x").mkdir(parents=True)
    for name, data in {"a.md": b"\xef\xbb\xbf# A", "B.MD": b"b", "c.markdown": b"c", "d.txt": b"d", "e.json": b"{}", "sub/f.md": b"f", "sub/g.md": b"", "sub/.x/h.md": b"h"}.items():
        (tmp_path / name).write_bytes(data)
    assert sorted(Path(r["path"]).name for r in inventory.scan_inventory(spark, str(tmp_path)).collect()) == ["B.MD", "a.md", "c.markdown"]
    assert inventory.scan_inventory(spark, str(tmp_path), "any", True).count() == 7
    files = spark.createDataFrame([(1, f"{tmp_path}/a.md"), (2, f"{tmp_path}/no.md"), (3, f"{tmp_path}/c.markdown"), (4, f"{tmp_path}/sub/g.md")], "id long, full_path string")
    got = {r["file_id"]: (r["text"], r["missing"]) for r in inventory.read_content(spark, files, str(tmp_path)).collect()}
    assert got == {1: ("# A", False), 2: (None, True), 3: ("c", False), 4: ("", False)}


def test_content_is_opened_by_path(spark, tmp_path, monkeypatch):
    """Nothing is listed to read documents, and those are read that a listing gives."""
    (tmp_path / "lib" / ".x").mkdir(parents=True)
    names = ["lib/a.md", "lib/_u.MD", "lib/.x/h.md", "lib/d.txt", "o.md"]
    for name in names:
        (tmp_path / name).write_text(name)
    rows = [*enumerate(f"{tmp_path}/{name}" for name in names), (5, f"{tmp_path}/lib/../o.md"), (6, f"{tmp_path}/lib"), (7, None), (8, f"{tmp_path}/lib//a.md")]
    listing_of = {r["path"] for r in inventory.scan_inventory(spark, str(tmp_path / "lib"), recursive=True).collect()}
    monkeypatch.setattr(inventory, "scan", None)
    monkeypatch.setattr(inventory, "HELD", 3)
    for root in (f"{tmp_path}/lib", f"file://{tmp_path}/lib/"):
        found = inventory.read_content(spark, spark.createDataFrame(rows, "id long, full_path string"), root)
        assert {r["file_id"]: (r["text"], r["missing"]) for r in found.collect()} == {i: ("/".join(path.split("/")[-2:]), False) if path in listing_of else (None, True) for i, path in rows}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    kept = store.GraphStore(spark, str(tmp_path / "graphs"), 1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4kb")
    try:
        found = kept._write(spark.range(0, 20_000, 1, 4).select(F.col("id").alias("file_id"), F.col("id").alias("graph_id")), "members", "graph_id", str(tmp_path / "data"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(Path(found["0"]).glob("*.parquet"))) > 1 and spark.read.parquet(found["0"]).count() == 20_000


def test_listings_of_wide_and_deep_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "BUDGET", 5)
    wanted = set()
    for i in range(12):
        folder = tmp_path / "/".join(f"d{k}" for k in range(i % 5)) / f"w{i}"
        folder.mkdir(parents=True)
        for name in ("a.md", "b.MARKDOWN", "c.txt"):
            (folder / name).write_text("x" * i)
            wanted |= {(str(folder / name), i)} if name != "c.txt" else set()
    found = inventory.scan_inventory(spark, str(tmp_path), recursive=True)
    assert {(r["path"], r["length"]) for r in found.collect()} == wanted and found.count() == len(wanted) and found.where("modification_time is null").isEmpty()
    read = listing.registered(spark).read.format("listing").option("recursive", "true").load(f"file://{tmp_path}")
    assert {(r["path"], r["length"]) for r in read.collect()} == wanted
    assert inventory.scan_inventory(spark, str(tmp_path / "none"), recursive=True).isEmpty()


def test_racing_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "cat")
    catalog.save_catalog(spark, {"files": spark.range(1), "folders": spark.range(5)}, root)

    def add(n):
        catalog.update_catalog(spark, root, lambda tables: tables | {"files": tables["files"].union(spark.range(n, n + 1))})

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(1, 9)))
    tables = catalog.load_catalog(spark, root)
    assert sorted(r[0] for r in tables["files"].collect()) == list(range(9)) and tables["folders"].count() == 5
    assert len(list((tmp_path / "cat" / "versions").glob("*/folders"))) == 1 and len(list((tmp_path / "cat" / "published").iterdir())) == 9
    (tmp_path / "cat" / "published" / "000000000010.json").touch()  # of a writer that died
    assert catalog.load_catalog(spark, root)["files"].count() == 9


def test_catalog_versions(spark, tmp_path):
    root = str(tmp_path / "cat")
    assert catalog.load_catalog(spark, root) == {}
    for n in (1, 2):
        catalog.save_catalog(spark, {"files": spark.range(n), "members": spark.createDataFrame([(1, 1)], graphs.MEMBERS)}, root, buckets=2)
        assert catalog.load_catalog(spark, root)["files"].count() == n
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        catalog.save_catalog(spark, {"files": bad}, root)
    assert catalog.load_catalog(spark, root)["files"].count() == 2


def test_bundles(spark, tmp_path):
    members, files = spark.createDataFrame([(1, 1), (1, 2)], graphs.MEMBERS), spark.createDataFrame([(1, "A"), (2, "B")], "id long, title string")
    content, index = spark.createDataFrame([(1, "x")], "file_id long, text string"), spark.createDataFrame([(1, "<html>"), (2, "none")], "graph_id long, html string")
    out = export.export_bundles(members, files, content, index, F.lit("2026-06-30 18:04:00").cast("timestamp"))
    bundles.write_export_bundles(out, str(tmp_path / "b"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "b")).select("graph_id", "bundle", "file_name").collect())
    assert got == [(1, "30-06-2026_18-04-UTC.zip", "1-a.md"), (1, "30-06-2026_18-04-UTC.zip", "index.html")]
    assert sorted(r["file_name"] for r in bundles.read_export_bundle(spark, str(tmp_path / "b"), 1).collect()) == ["1-a.md", "index.html"]
    assert bundles.read_export_bundle(spark, str(tmp_path / "b"), 2).isEmpty() and not list((tmp_path / "b").glob("graph_id=*"))


def test_stream_ingest_is_idempotent(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    rows = []
    load = lambda: spark.createDataFrame(rows, "id long, full_path string, title string, folder_id long, sort_order int")
    add = lambda df: rows.extend(tuple(r) for r in df.collect())
    for step, name in enumerate(["b.md", "a.MD"]):
        (root / name).write_text("x" * step)
        os.utime(root / name, (1, 1 - step))  # older than what came before
        jobs.stream_ingest(spark, str(root), str(tmp_path / "ck"), load, add).awaitTermination()
        assert len(rows) == step + 1
    jobs.stream_ingest(spark, str(root), str(tmp_path / "again"), load, add).awaitTermination()
    assert [(r[0], Path(r[1]).name, r[4]) for r in rows] == [(1, "b.md", 1), (2, "a.MD", 2)]


def test_stream_last_touch(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(id * 7 % 100) ts, id % 5 file_id, if(id % 2 = 0, 'open', 'save') kind from range(200)")
    rows.repartition(4).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    query = jobs.stream_last_touch(stream).writeStream.outputMode("complete").format("memory").queryName("touch").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("touch").collect()) == sorted(patches.last_touch(rows).collect())


def test_stream_links_equal_batch(spark, tmp_path):
    links = spark.createDataFrame([(1, 2, "child"), (3, 4, "sibling"), (2, 3, "parent"), (5, 5, "child"), (8, 9, "reference"), (1, 2, "child")], "doc_id long, other_id long, ui_kind string")
    links.repartition(3).write.parquet(str(tmp_path / "l"))
    files = spark.range(1, 10)
    kept = store.GraphStore(spark, str(tmp_path / "graphs"), 4)
    stream = spark.readStream.schema(links.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    jobs.stream_links(stream, files, kept, str(tmp_path / "ck")).awaitTermination()
    batch = graphs.merge_links(graphs.empty_state(spark), relations.normalize_relations(links, files).where("reason is null").select("from_id", "to_id", "kind"))
    groups = lambda s: sorted(sorted(r["f"]) for r in s.members.groupBy("graph_id").agg(F.collect_list("file_id").alias("f")).collect())
    assert groups(kept.state()) == groups(batch) == [[1, 2, 3, 4], [8, 9]]
    assert kept.merge(batch.edges.select("from_id", "to_id", "kind")) == []  # merged again


def test_a_batch_rewrites_only_the_buckets_that_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDERS", 2)
    kept = store.GraphStore(spark, str(tmp_path / "graphs"), 16)
    edge = lambda *pairs: spark.createDataFrame([(a, b, "reference") for a, b in pairs], "from_id long, to_id long, kind string")
    batches = [[(10 * i, 10 * i + 1) for i in range(20)], [(0, 10), (5, 6)], [(0, 20)], [(11, 40), (6, 190)], [(20, 21)]]
    state = graphs.empty_state(spark)
    for n, pairs in enumerate(batches):
        before = kept._last()[1].get("folders", {}).get("members", {})
        touched = kept.merge(edge(*pairs))
        after = kept._last()[1]["folders"]["members"]
        if n:
            assert len(touched) <= 2 * len(pairs) and all(after.get(b) == own for b, own in before.items() if int(b) not in touched and n != 1)
        state = graphs.merge_links(state, edge(*pairs))
    groups = lambda s: sorted(sorted(r["f"]) for r in s.members.groupBy("graph_id").agg(F.collect_list("file_id").alias("f")).collect())
    own = kept.state()
    assert groups(own) == groups(state) and sorted(map(tuple, own.edges.select("from_id", "to_id", "kind").collect())) == sorted(map(tuple, state.edges.select("from_id", "to_id", "kind").collect()))
    assert own.graphs.count() == own.members.select("graph_id").distinct().count() == 17 and kept._last()[0] == 4
    assert own.edges.join(own.members.selectExpr("graph_id as g", "file_id as from_id"), "from_id").where("g <> graph_id").isEmpty()
