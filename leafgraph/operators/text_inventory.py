"""What documents' Markdown holds: fenced blocks and links."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions import markdown
from leafgraph.functions.texts import is_external


def host_endings(spark: SparkSession) -> frozenset[str]:
    """Endings of hosts that make a bare host an address: some general ones, and those of the countries that Java knows."""
    countries = {c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()}
    return frozenset({*markdown.ENDINGS, *countries, "uk", "eu", "su", "ac"} - {"gb"})


def _counted(content: DataFrame, which: int, schema: str, keys: list[str]) -> DataFrame:
    """(…keys, n): what the scanner finds in each batch of texts, counted, then added up."""
    endings, by_file = host_endings(content.sparkSession), "file_id" in keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for i in range(batch.num_rows):
                for value in markdown.scan(batch.column(1)[i].as_py(), endings)[which]:
                    counts[(batch.column(0)[i].as_py(), value) if by_file else (value,)] += 1
            columns = list(zip(*((*k, n) for k, n in counts.items()), strict=True)) or [[]] * (len(keys) + 1)
            kinds = [*([batch.column(0).type] if by_file else []), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*keys, "n"])

    found = content.select("file_id", "text").mapInArrow(run, schema)
    return found.groupBy(*keys).agg(F.sum("n").alias("n"))


def fence_inventory(content: DataFrame) -> DataFrame:
    """(file_id, lang, kind, n): fenced blocks by language; mermaid is a diagram, others code, without a language plain.

    Fences in quotes and list items count, and those that nothing closes; what stands in a fence or in indented code is no
    fence. A null text has none.
    """
    kind = F.when(F.col("lang") == "mermaid", "diagram").when(F.col("lang") == "", "plain").otherwise("code")
    found = _counted(content, 0, f"file_id {content.schema['file_id'].dataType.simpleString()}, lang string, n long", ["file_id", "lang"])
    return found.select("file_id", "lang", kind.alias("kind"), "n")


def link_inventory(content: DataFrame) -> DataFrame:
    """(href, external, n) over all documents: inline and reference links, autolinks, bare addresses, hosts and mail addresses.

    What stands in code or in the text of an image doesn't count, nor do images. Addresses are percent-encoded; those of
    schemes that run code are no links.
    """
    return _counted(content, 1, "href string, n long", ["href"]).select("href", is_external(F.col("href")).alias("external"), "n")
