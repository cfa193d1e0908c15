"""Text and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_ws(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_ws(c), F.lit("")) == ""


def slug(c: Column) -> Column:
    """Lower case, runs outside a-z and 0-9 as one hyphen, none at the ends; doc if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", "doc").otherwise(text)


def export_file_name(file_id: Column, title: Column) -> Column:
    return F.concat(file_id.cast("string"), F.lit("-"), slug(title), F.lit(".md"))


def truncate_label(c: Column, file_id: Column, n: int = 18) -> Column:
    """At most n characters, an ellipsis being the last where it was longer; #id for an empty title."""
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.concat(F.lit("#"), file_id.cast("string"))).when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def escape_html(c: Column, quotes: bool = False) -> Column:
    """& < > and \" as entities, with `quotes` the apostrophe too; '' for null."""
    out = F.coalesce(c, F.lit(""))
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *[("'", "&#39;")] * quotes]:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def format_size(b: Column) -> Column:
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1024 * 1024, F.format_string("%.1f KB", b / 1024)).otherwise(F.format_string("%.1f MB", b / 1024 / 1024))


def bundle_name(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "dd-MM-yyyy_HH-mm"), F.lit("-UTC.zip"))


def is_external(href: Column) -> Column:
    return href.rlike("(?i)^https?:")


def number_text(x: Column) -> Column:
    """A multiple of one half without a needless .0, as it stands in SVG paths."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", x))
