"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(c: Column) -> Column:
    """An absolute path with . and .. and empty segments folded; .. at the root stays there."""
    def fold(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), fold), "/"))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def path_ext(c: Column) -> Column:
    """From the last dot of the last segment; '' without one or with nothing behind it."""
    return F.regexp_extract(c, r"(\.[^./\\]+)$", 1)


def path_title(c: Column) -> Column:
    """The file name without its last extension; .md gives ''."""
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def base_name(c: Column) -> Column:
    """The last piece behind / or \\, lower-cased; '' for null."""
    return F.lower(F.element_at(F.split(F.coalesce(c, F.lit("")), r"[\\/]"), -1))


def parent_path(c: Column) -> Column:
    """The directory of a canonical path; / for what lies in the root."""
    cut = F.regexp_replace(c, "/[^/]*$", "")
    return F.when(cut == "", "/").otherwise(cut)


def fold_case(c: Column) -> Column:
    """What case-insensitive equality and order go by: upper case, so that _ sorts after letters."""
    return F.upper(c)


def is_markdown(c: Column) -> Column:
    return F.lower(path_ext(c)).isin(".md", ".markdown")


def of_kind(c: Column, kind: str) -> Column:
    """Whether a path is of the kind md, json or any."""
    if kind not in ("md", "json", "any"):
        raise ValueError(f"unknown kind {kind}")
    return F.lit(True) if kind == "any" else is_markdown(c) if kind == "md" else F.lower(path_ext(c)) == ".json"
