"""Bulk catalog ingest: which paths to add, in which order, under which numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions.paths import canonical_path, fold_case, is_markdown, of_kind, parent_path, path_ext, path_title
from leafgraph.functions.texts import is_blank, trim_ws
from leafgraph.operators.numbering import number_rows
from leafgraph.session import cut, small_side

#: Titles that queries meet at a time; rows that a task finds, about.
PIECE, ROWS = 10_000, 5_000_000


def on_disk(inventory: DataFrame) -> DataFrame:
    """(path, length) of the inventory under canonical paths, a row each."""
    return inventory.groupBy(canonical_path(F.col("path")).alias("path")).agg(F.max("length").alias("length"))


def with_missing(files: DataFrame, inventory: DataFrame, path_col: str = "full_path") -> DataFrame:
    """files with a column `missing`: whether its path is absent from the disk."""
    there = on_disk(inventory).select(F.col("path").alias("__path"), F.lit(True).alias("__there"))
    return files.join(there, F.col(path_col) == F.col("__path"), "left").select(*[files[c] for c in files.columns], F.col("__there").isNull().alias("missing"))


def file_details(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """(id, exists, length, modification_time): the last two are null for a missing document or where the inventory has none."""
    more = [c for c in ("modification_time",) if c in inventory.columns]
    there = inventory.groupBy(canonical_path(F.col("path")).alias("__path")).agg(F.max("length").alias("length"), *[F.max(c).alias(c) for c in more])
    joined = files.join(there, F.col("full_path") == F.col("__path"), "left")
    return joined.select("id", F.col("__path").isNotNull().alias("exists"), "length", *more)


def first_per_key(paths: DataFrame) -> DataFrame:
    """(path) without repeats that differ by case only: of each such group the first in order stays."""
    order = Window.partitionBy(fold_case(F.col("path"))).orderBy("path")
    return paths.select("path").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def new_paths(scan: DataFrame, files: DataFrame) -> DataFrame:
    """scan's rows whose path isn't managed yet, whatever its case."""
    known = files.select(fold_case(F.col("full_path")).alias("__key"))
    return scan.join(known, fold_case(F.col("path")) == F.col("__key"), "left_anti")


def max_sort_order(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("sort_order"), F.lit(0))).first()[0]


def ingest(inventory: DataFrame, files: DataFrame, folder_id: int | None = None) -> DataFrame:
    """New rows (id, full_path, title, folder_id, sort_order) for the inventory's Markdown files that aren't managed.

    Both numbers go on from the largest in files, in case-insensitive path order.
    """
    scan = inventory.where(is_markdown(F.col("path"))).select(canonical_path(F.col("path")).alias("path"))
    fresh = new_paths(first_per_key(scan), files).withColumn("__key", fold_case(F.col("path")))
    top = files.agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("s"), F.coalesce(F.max("id"), F.lit(0)).alias("i")).first()
    numbered = number_rows(fresh, ["__key", "path"], "n")
    return numbered.select((F.col("n") + top["i"]).alias("id"), F.col("path").alias("full_path"), path_title(F.col("path")).alias("title"), F.lit(folder_id).cast("long").alias("folder_id"), (F.col("n") + top["s"]).cast("int").alias("sort_order"))


def ingest_summary(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, added, skipped): of the Markdown files in each directory of the inventory, how many are new and how many are managed or repeats."""
    scan = inventory.where(is_markdown(F.col("path"))).select(canonical_path(F.col("path")).alias("path"))
    known = files.select(fold_case(F.col("full_path")).alias("__key"), F.lit(True).alias("__known")).distinct()
    order = Window.partitionBy(fold_case(F.col("path"))).orderBy("path")
    marked = scan.withColumn("__n", F.row_number().over(order)).join(known, fold_case(F.col("path")) == F.col("__key"), "left")
    added = F.col("__known").isNull() & (F.col("__n") == 1)
    return marked.groupBy(parent_path(F.col("path")).alias("directory")).agg(F.count_if(added).alias("added"), F.count_if(~added).alias("skipped"))


def validate_adds(requests: DataFrame, inventory: DataFrame, files: DataFrame) -> DataFrame:
    """requests (path, ...) with canonical, reason and existing_id; reason is null for accepted ones.

    The first that holds: blank, invalid (a zero character), extension, not_on_disk, managed (with the id of the managed row).
    """
    path = canonical_path(F.col("path"))
    disk = on_disk(inventory).select(F.col("path").alias("__path"))
    known = files.groupBy(fold_case(F.col("full_path")).alias("__key")).agg(F.min("id").alias("__id"))
    joined = requests.withColumn("canonical", path).join(disk, F.col("canonical") == F.col("__path"), "left").join(known, fold_case(F.col("canonical")) == F.col("__key"), "left")
    reason = F.when(is_blank(F.col("path")), "blank").when(F.col("path").contains("\u0000"), "invalid").when(~is_markdown(F.col("canonical")), "extension").when(F.col("__path").isNull(), "not_on_disk").when(F.col("__id").isNotNull(), "managed")
    return joined.withColumn("reason", reason).select(*[requests[c] for c in requests.columns], "canonical", "reason", F.when(F.col("reason") == "managed", F.col("__id")).alias("existing_id"))


def validate_new_files(requests: DataFrame, inventory: DataFrame, files: DataFrame) -> DataFrame:
    """requests (dir, name) with full_path, reason and, for accepted ones, body.

    The first that holds: blank, no_directory, invalid_name, extension, managed, exists. A name without an extension gets .md.
    """
    name = trim_ws(F.col("name"))
    full_name = F.when(path_ext(name) == "", F.concat(name, F.lit(".md"))).otherwise(name)
    disk = on_disk(inventory)
    directories = disk.select(parent_path(F.col("path")).alias("__dir")).distinct()
    known = files.select(fold_case(F.col("full_path")).alias("__key")).distinct()
    rows = requests.withColumn("full_path", canonical_path(F.concat(F.col("dir"), F.lit("/"), full_name))).withColumn("__d", canonical_path(F.col("dir")))
    joined = rows.join(directories, F.col("__d") == F.col("__dir"), "left").join(known, fold_case(F.col("full_path")) == F.col("__key"), "left").join(disk.select(F.col("path").alias("__path")), F.col("full_path") == F.col("__path"), "left")
    reason = F.when(is_blank(F.col("dir")) | is_blank(F.col("name")), "blank").when(F.col("__dir").isNull(), "no_directory").when(name.rlike("[/\u0000]"), "invalid_name").when(~is_markdown(full_name), "extension").when(F.col("__key").isNotNull(), "managed").when(F.col("__path").isNotNull(), "exists")
    body = F.concat(F.lit("# "), path_title(F.col("full_path")), F.lit("\n"))
    return joined.withColumn("reason", reason).select(*[requests[c] for c in requests.columns], "full_path", "reason", F.when(F.col("reason").isNull(), body).alias("body"))


def list_directory(inventory: DataFrame, directory: str, kind: str = "md") -> DataFrame:
    """(name, path, is_dir, parent) of a directory's children: directories first, then by name whatever its case."""
    base = "/" if directory == "/" else directory.rstrip("/") + "/"
    below = on_disk(inventory).where(F.col("path").startswith(base)).select("path", F.substring("path", len(base) + 1, 1 << 20).alias("rest"))
    is_dir = F.col("rest").contains("/")
    rows = below.where(is_dir | of_kind(F.col("path"), kind)).select(F.substring_index("rest", "/", 1).alias("name"), is_dir.alias("is_dir")).distinct()
    rows = rows.select("name", F.concat(F.lit(base), "name").alias("path"), "is_dir", F.lit(directory).alias("parent"))
    return rows.orderBy(F.desc("is_dir"), fold_case(F.col("name")), "name")


def search_titles(files: DataFrame, queries: DataFrame, ordered: bool = True) -> DataFrame:
    """(query_id, id, title) for queries (query_id, q, exclude_id): titles that contain q whatever its case, in tree order.

    An empty q matches all, a null one nothing. Each distinct q is looked up by the rarest of its runs of three
    characters (by itself if it is shorter) in an index of the titles' runs, and what is found is compared in full, so
    texts meet only if they share that run. What a q finds is dealt out in pieces of some PIECE titles, which its queries
    meet one by one, so that a common q asked often isn't one task's. Rows aren't sorted unless `ordered`: they may be as
    many as queries times titles.
    """
    text = F.lower("title")
    runs = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    asked = queries.select("query_id", F.lower("q").alias("q"), "exclude_id")
    distinct = asked.where("q is not null").select("q").distinct()
    titles = files.where("title is not null")
    own = cut(distinct.select("q", F.explode(F.when(F.length("q") >= 3, F.array_distinct(runs(F.col("q"), 3))).otherwise(F.array("q"))).alias("run")))
    index = titles.select("id", F.explode(F.array_distinct(F.concat(runs(text, 1), runs(text, 2), runs(text, 3), F.array(F.lit(""))))).alias("run"))
    index = cut(index.join(small_side(cut(own.select("run").distinct())), "run", "left_semi"))
    rarest = cut(own.join(index.groupBy("run").agg(F.count("*").alias("n")), "run").groupBy("q").agg(F.min_by("run", F.struct("n", "run")).alias("run")))
    met = index.join(small_side(rarest), "run").select("q", "id").join(titles.select("id", "title", "sort_order"), "id").where(F.contains(text, F.col("q")))
    met = cut(met.select("q", "id", "title", "sort_order"))
    sizes = met.groupBy("q").agg(F.count("*").alias("n")).join(asked.groupBy("q").agg(F.count("*").alias("asked")), "q")
    pieces = cut(sizes.select("q", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"), (F.col("n") * F.col("asked")).alias("rows")))
    tasks = max(1, -(-(pieces.agg(F.sum("rows")).first()[0] or 0) // ROWS))
    pieces = pieces.drop("rows")
    dealt = met.join(small_side(pieces), "q").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    asked = asked.join(small_side(pieces), "q").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asked, dealt = (df.drop("pieces").repartition(tasks, "q", "piece") for df in (asked, dealt))  # as many tasks as there is to find, not to read
    found = asked.join(dealt, ["q", "piece"]).where(~F.col("id").eqNullSafe(F.col("exclude_id")))
    return (found.orderBy("query_id", "sort_order", "title", "id") if ordered else found).select("query_id", "id", "title")
