"""Color maps: lenient JSON documents that give files a color."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.paths import base_name, file_name
from leafgraph.functions.texts import is_blank, trim_ws


def _lower_keys(m: Column) -> Column:
    """A map with lower-case keys; of keys that become equal the last wins."""
    return F.aggregate(F.map_entries(m), F.create_map().cast("map<string,string>"), lambda a, e: F.map_concat(F.map_filter(a, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def _items(text: Column, a: str, b: str) -> Column:
    items = F.transform(F.from_json(text, "array<map<string,string>>"), _lower_keys)
    return F.transform(items, lambda m: F.struct(F.coalesce(F.try_element_at(m, F.lit(a.replace("_", ""))), F.lit("")).alias(a), F.coalesce(F.try_element_at(m, F.lit(b)), F.lit("")).alias(b)))


def read_color_maps(maps: DataFrame) -> DataFrame:
    """maps (json, ...) with list_name, legend array<struct<color,meaning>> and files array<struct<file_path,color>>; null where the JSON is bad.

    Property names match whatever their case.
    """
    top = _lower_keys(F.from_json("json", "map<string,string>"))
    parsed = maps.withColumn("__m", top)
    get = lambda k: F.try_element_at("__m", F.lit(k))
    empty = lambda c, kind: F.when(F.col("__m").isNotNull(), F.coalesce(c, F.array().cast(kind)))
    return parsed.select(*maps.columns, F.col("__m").isNotNull().alias("parsed"), get("listname").alias("list_name"), empty(_items(get("legend"), "color", "meaning"), "array<struct<color:string,meaning:string>>").alias("legend"), empty(_items(get("files"), "file_path", "color"), "array<struct<file_path:string,color:string>>").alias("files"))


def validate_color_maps(maps: DataFrame) -> DataFrame:
    """maps (json, file_path, ...) read, with reason: invalid (bad JSON or null), empty (no entry with path and color), or null."""
    read = read_color_maps(maps)
    files = F.filter("files", lambda x: ~is_blank(x["file_path"]) & ~is_blank(x["color"]))
    name = F.when(is_blank(F.col("list_name")), file_name(F.col("file_path"))).otherwise(trim_ws(F.col("list_name")))
    reason = F.when(~F.col("parsed"), "invalid").when(F.size("files") == 0, "empty")
    return read.withColumn("files", files).withColumn("list_name", name).withColumn("reason", reason).drop("parsed")


def color_by_basename(read: DataFrame) -> DataFrame:
    """(id, basename, color) of maps that were read: the last entry of each base name."""
    entries = read.select("id", F.posexplode("files").alias("pos", "f"))
    return entries.groupBy("id", base_name(F.col("f.file_path")).alias("basename")).agg(F.max_by("f.color", "pos").alias("color"))


def node_colors(nodes: DataFrame, colors: DataFrame, map_id: int | None = None) -> DataFrame:
    """nodes (path, title, ...) with color: that of the base name of the path, else of the title; null without a match.

    colors: color_by_basename of one map (map_id picks it), or, without map_id, with an id that nodes carry as map_id.
    """
    key = base_name(F.when(F.coalesce("path", F.lit("")) == "", F.col("title")).otherwise(F.col("path")))
    own = colors.where(F.col("id") == map_id) if map_id is not None else colors
    own = own.select(F.col("id").alias("__m"), F.col("basename").alias("__b"), "color")
    same = (key == F.col("__b")) & (F.lit(True) if map_id is not None else F.col("map_id") == F.col("__m"))
    return nodes.join(own, same, "left").select(*[nodes[c] for c in nodes.columns], "color")


def legend_text(read: DataFrame) -> DataFrame:
    """(id, legend_text): a line for each color, or the map's source path without any."""
    lines = F.array_join(F.transform("legend", lambda x: F.concat(x["color"], F.lit(" — "), x["meaning"])), "\n")
    return read.select("id", F.when(F.coalesce(F.size("legend"), F.lit(0)) > 0, lines).otherwise(F.col("file_path")).alias("legend_text"))


def color_map_list(maps: DataFrame) -> DataFrame:
    return read_color_maps(maps).orderBy("id")
