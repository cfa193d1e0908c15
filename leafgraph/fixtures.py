"""Test inputs derived in SQL from the standard tables; the texts run in Spark and DuckDB unchanged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
VIEWS = {
    "fx_files": """
SELECT p_partkey AS id,
 concat('/lib/', p_type, '/', replace(p_name,' ','_'), '-', CAST(p_partkey AS STRING),
   CASE p_partkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.MD' ELSE '.markdown' END) AS full_path,
 p_name AS title,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 97 END AS folder_id,
 p_size AS sort_order FROM part
""",
    "fx_inventory": """
SELECT full_path AS path, CAST(100 + id AS BIGINT) AS length FROM fx_files WHERE id % 10 <> 3
 UNION ALL SELECT concat('/lib/', p_type, '/n', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.Md' WHEN 2 THEN '.txt' ELSE '.json' END), CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey % 5 = 0
 UNION ALL SELECT upper(full_path), CAST(100 + id AS BIGINT) FROM fx_files WHERE id % 6 = 1
 UNION ALL SELECT concat('/lib/x/../', p_type, '/./N', CAST(p_partkey AS STRING), '.md'), CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey % 20 = 0
""",
    "fx_folders": """
SELECT c_custkey AS id, c_name AS name,
 CASE WHEN c_custkey < 8 THEN NULL ELSE CAST(FLOOR(c_custkey / 8) AS BIGINT) END AS parent_id,
 c_nationkey AS sort_order FROM customer WHERE c_custkey > 0
 UNION ALL SELECT 1000000 + c_custkey, concat('loop', CAST(c_custkey AS STRING)), 1000000 + (c_custkey + 1) % 3, 1 FROM customer WHERE c_custkey < 3
 UNION ALL SELECT 2000000 + c_custkey, concat('dangling', CAST(c_custkey AS STRING)), CAST(3000000 AS BIGINT), 1 FROM customer WHERE c_custkey < 3
""",
    "fx_relations": """
SELECT CASE WHEN turned = 1 AND far = 0 THEN near ELSE p END AS from_id, CASE WHEN far = 1 THEN away WHEN turned = 1 THEN p ELSE near END AS to_id, kind
 FROM (SELECT p, turned, kind, CASE kind WHEN 'companion' THEN 1 ELSE 0 END AS far, h % (SELECT count(*) + 20 FROM part) AS away,
  p - p % 20 + (p % 20) - (p % 20) % w + h % w AS near
  FROM (SELECT l_partkey AS p, 1 + CAST(FLOOR(l_partkey / 20) AS BIGINT) * 7 % 20 AS w, l_partkey*31 + l_suppkey*17 + l_linenumber AS h, l_linenumber % 2 AS turned,
   CASE WHEN l_partkey % 80 >= 60 THEN 'companion' WHEN l_linenumber = 7 THEN 'see' WHEN l_linenumber % 4 = 0 THEN 'sibling' WHEN l_linenumber % 4 = 1 THEN 'companion' ELSE 'reference' END AS kind
   FROM lineitem) rows) ends
 UNION ALL SELECT p_partkey, p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'companion' ELSE 'reference' END FROM part
""",
    "fx_dag": """
SELECT DISTINCT least(from_id,to_id) AS from_id, greatest(from_id,to_id) AS to_id FROM fx_relations WHERE kind='reference' AND from_id<>to_id
""",
    "fx_items": """
SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS k, CAST(10000000 + l_orderkey*8 + l_linenumber AS BIGINT) AS item FROM lineitem
""",
    "fx_deep": """
SELECT CAST(o_orderkey AS BIGINT) AS from_id, CAST(o_orderkey - 1 AS BIGINT) AS to_id FROM orders WHERE o_orderkey > 0
 UNION ALL SELECT k, item FROM fx_items UNION ALL SELECT item, k - 1 FROM fx_items WHERE k > 0
""",
    "fx_ring": """
SELECT CAST(o_orderkey AS BIGINT) AS from_id, CAST((o_orderkey + 1) % (SELECT count(*) FROM orders) AS BIGINT) AS to_id FROM orders UNION ALL SELECT k, item FROM fx_items
""",
    "fx_shapes": """
SELECT CAST(o_orderkey AS BIGINT) AS from_id, CAST(o_orderkey + 1 AS BIGINT) AS to_id FROM orders
 UNION ALL SELECT item, CAST(5000000 AS BIGINT) FROM fx_items
 UNION ALL SELECT CAST(20000000 + o_orderkey AS BIGINT), CAST(20000000 + FLOOR(o_orderkey * 37 / 100) AS BIGINT) FROM orders WHERE o_orderkey > 0
""",
    "fx_links": """
SELECT l_orderkey*8 + l_linenumber AS seq, l_partkey AS doc_id,
 CASE WHEN l_quantity < 4 THEN l_partkey WHEN l_linenumber % 6 = 3 THEN (l_partkey*13 + l_suppkey*7) % (SELECT count(*) + 20 FROM part) ELSE l_partkey - l_partkey % 100 + (l_partkey*13 + l_suppkey*7) % 100 END AS other_id,
 CASE l_linenumber % 6 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'sibling' WHEN 3 THEN 'companion' WHEN 4 THEN 'reference' ELSE 'cousin' END AS ui_kind
 FROM lineitem
""",
    "fx_attachments": """
SELECT o_orderkey AS id, o_custkey * 2 AS file_id, concat('f', CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.zip' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.md' WHEN 3 THEN '.svg' WHEN 4 THEN '.unheard' ELSE '' END) AS file_name,
 CASE o_orderkey % 3 WHEN 0 THEN 'export' WHEN 1 THEN 'upload' ELSE 'reference' END AS kind,
 CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE concat('s', CAST(o_orderkey AS STRING)) END AS stored_name,
 CAST(floor(o_totalprice*100) AS BIGINT) AS size_bytes, o_orderdate AS created_utc FROM orders
""",
    "fx_touch": """
SELECT event_id AS seq, ts, user_id AS file_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'save' END AS kind FROM events WHERE event_type IN ('view','purchase')
""",
    "fx_patches": """
SELECT event_id AS seq, user_id AS id, CASE WHEN event_type='click' THEN concat('  t', CAST(event_id AS STRING), ' ') END AS title,
 CASE WHEN event_type='signup' THEN event_id % 50 END AS folder_id, event_type='error' AS move_to_root,
 CASE WHEN event_type='view' THEN CAST(event_id % 100 AS INT) END AS sort_order FROM events
""",
    "fx_moves": """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_custkey * 8 + 3 WHEN 1 THEN (c_custkey*5 + 3) % (SELECT count(*) FROM customer) ELSE c_custkey END AS new_parent FROM customer
""",
    "fx_drawn_nodes": """
SELECT CAST(c_custkey AS BIGINT) AS graph_id, CAST(c_custkey * 10 + node AS BIGINT) AS file_id FROM customer
 JOIN (VALUES (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3), (3, 4), (4, 1), (4, 2), (5, 1), (5, 2), (6, 1), (7, 1), (7, 2), (8, 1)) AS s(shape, node) ON c_custkey % 9 = shape
""",
    "fx_drawn_edges": """
SELECT CAST(c_custkey AS BIGINT) AS graph_id, CAST(c_custkey * 10 + a AS BIGINT) AS from_id, CAST(c_custkey * 10 + b AS BIGINT) AS to_id, kind, CAST(seq AS BIGINT) AS seq FROM customer
 JOIN (VALUES (0, 1, 2, 'reference', 0), (0, 2, 3, 'reference', 1), (1, 1, 2, 'reference', 0), (1, 1, 3, 'reference', 1), (1, 2, 4, 'reference', 2), (1, 1, 4, 'reference', 3), (2, 1, 2, 'reference', 0), (2, 2, 3, 'sibling', 1), (2, 3, 4, 'reference', 2),
  (3, 1, 4, 'reference', 0), (3, 2, 3, 'reference', 1), (4, 1, 2, 'reference', 0), (4, 2, 1, 'reference', 1), (5, 2, 1, 'reference', 0), (5, 1, 2, 'reference', 1), (6, 1, 1, 'reference', 0), (7, 1, 2, 'reference', 0), (7, 1, 2, 'sibling', 1), (8, 1, 9, 'reference', 0)) AS s(shape, a, b, kind, seq) ON c_custkey % 9 = shape
""",
    "fx_deep_folders": """
SELECT CAST(o_orderkey AS BIGINT) AS id, concat('f', CAST(o_orderkey AS STRING)) AS name, CASE WHEN o_orderkey > 0 THEN CAST(o_orderkey - 1 AS BIGINT) END AS parent_id, CAST(o_orderkey % 7 AS INT) AS sort_order FROM orders
""",
    "fx_deep_moves": """
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey + o_orderkey * 7919 % 2500 - 400 AS BIGINT) AS new_parent FROM orders
""",
    "fx_triples": """
SELECT CAST(2 * c_custkey AS BIGINT) AS id, concat('a', CAST(c_custkey AS STRING)) AS name, CAST(NULL AS BIGINT) AS parent_id, 1 AS sort_order FROM customer
 UNION ALL SELECT 2 * c_custkey + 1, concat('b', CAST(c_custkey AS STRING)), NULL, 1 FROM customer
 UNION ALL SELECT 10000000 + c_custkey, concat('d', CAST(c_custkey AS STRING)), 2 * c_custkey + 1, 1 FROM customer
""",
    "fx_triple_moves": """
SELECT CAST(step * 1000000 + c_custkey AS BIGINT) AS seq, CAST(CASE WHEN step IN (2, 4) THEN 2 * c_custkey + 1 WHEN step IN (3, 5, 7) THEN 10000000 + c_custkey ELSE 2 * c_custkey END AS BIGINT) AS id,
 CASE step WHEN 2 THEN 'bad' WHEN 3 THEN ' z ' END AS name,
 CAST(CASE step WHEN 1 THEN 10000000 + c_custkey WHEN 2 THEN 2 * c_custkey WHEN 4 THEN 2 * c_custkey WHEN 5 THEN 2 * c_custkey + 1 WHEN 6 THEN 99999999 WHEN 7 THEN 2 * c_custkey + 1 WHEN 8 THEN 2 * c_custkey - 2 WHEN 9 THEN 10000001 + c_custkey END AS BIGINT) AS parent_id,
 step = 3 AS move_to_root, CASE step WHEN 5 THEN 9 WHEN 7 THEN 3 END AS sort_order
 FROM customer JOIN (SELECT 1 AS step UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) steps ON (step <> 8 OR c_custkey % 2 = 1) AND (step <> 9 OR c_custkey % 2 = 0)
""",
    "fx_content": """
SELECT doc_id AS file_id, CASE doc_id % 4
 WHEN 0 THEN concat(repeat(chr(96),3), 'mermaid', chr(10), text, chr(10), repeat(chr(96),3), chr(10), text, chr(10), '~~~', chr(10), 'x', chr(10), '~~~')
 WHEN 1 THEN concat(text, chr(10), repeat(chr(96),3), 'sql', chr(10), text, chr(10), repeat(chr(96),3), chr(10), repeat(chr(96),3), 'sql', chr(10), repeat(chr(96),3), chr(10))
 WHEN 2 THEN concat(text, ' [a](docs/b.md) and [c](HTTPS://x.example.com/', CAST(doc_id AS STRING), ')', chr(10), text, ' http://bare.example.com/', CAST(doc_id % 9 AS STRING), chr(10))
 ELSE text END AS text FROM documents
""",
    "fx_markdown": """
SELECT doc_id, CASE doc_id % 10
 WHEN 0 THEN concat(whole, '[a](b(', id, ')d) and ', tick, '[q](code', id, ')', tick)
 WHEN 1 THEN concat(whole, '<http://auto.example/', id, '> and www.x', id, '.example.org now')
 WHEN 2 THEN concat(whole, '[r][1] and [1]', nl, nl, '[1]: /u', id, ' "t"')
 WHEN 3 THEN concat('- item', nl, nl, '  ', fence, 'sh', nl, '  [in](code)', nl, '  ', fence, nl, '- [b](item', id, ')', nl, whole)
 WHEN 4 THEN concat(whole, '> ', fence, 'c', nl, '> [x](quoted)', nl, '[after](m', id, ')')
 WHEN 5 THEN concat(fence, 'a', tick, 'b', nl, whole, '![i](x.png) [![i](y.png)](big', id, ')')
 WHEN 6 THEN concat(whole, nl, '    [x](indented)', nl, nl, chr(92), '[a](b) and [c](d', id, ')')
 WHEN 7 THEN concat(whole, '[x](javascript:f) [a [b](c', id, ') d](e)')
 WHEN 8 THEN concat(whole, fence, 'js', nl, '[x](y)', nl, text)
 ELSE concat('~~~ mermaid wide', nl, text, nl, '~~~~', nl, '[Ä Ö](ü', id, ')') END AS text
 FROM (SELECT doc_id, CAST(doc_id AS STRING) AS id, coalesce(text, '') AS text, chr(10) AS nl, chr(96) AS tick, repeat(chr(96), 3) AS fence,
  concat(repeat(chr(96), 9), 'txt', chr(10), coalesce(text, ''), chr(10), repeat(chr(96), 9), chr(10)) AS whole FROM documents) pieces
""",
    "fx_color_maps": """
SELECT CAST(s_suppkey + 1 AS BIGINT) AS id, f.id AS owner_file_id, concat('/maps/m', CAST(s_suppkey AS STRING), '.json') AS file_path,
 CASE WHEN s_suppkey % 7 = 6 THEN '{bad' WHEN s_suppkey % 7 = 5 THEN '{"files":[]}' ELSE
 concat('{"', CASE s_suppkey % 3 WHEN 0 THEN 'listName' WHEN 1 THEN 'ListName' ELSE 'other' END, '":" Map ', CAST(s_suppkey AS STRING), ' ","legend":[{"color":"#0a0","meaning":"ok"}],"Files":[{"filePath":"a/',
 upper(f.title), '-', CAST(f.id AS STRING), '.md","color":"#111"},{"FilePath":"', f.full_path, '","color":"#222"},{"filePath":"b', upper(f.full_path), '","Color":"#333"},{"filePath":" ","color":"#444"}]}') END AS json
 FROM supplier JOIN fx_files f ON f.id = s_suppkey * 2
""",
}


def needed(text: str) -> list[str]:
    """The views that a text names, and those that these name, in the order of VIEWS."""
    found: set[str] = set()
    todo = {v for v in VIEWS if re.search(rf"\b{v}\b", text)}
    while todo:
        found |= todo
        todo = {v for own in todo for v in VIEWS if re.search(rf"\b{v}\b", VIEWS[own])} - found
    return [v for v in VIEWS if v in found]


def oracle(text: str, **more: str) -> str:
    """DuckDB SQL: the views that are needed as WITH RECURSIVE entries, then `more` as further entries, then the text."""
    views = needed(" ".join([*more.values(), text]))
    entries = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{name} AS ({body})" for name, body in more.items()]
    return (f"WITH RECURSIVE {', '.join(entries)} " if entries else "") + text


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables in sf_dir."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", " ".join(VIEWS[v] for v in needed(name))):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed(name)) + f" SELECT * FROM {name}")
