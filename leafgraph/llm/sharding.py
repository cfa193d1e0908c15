"""Sharding by rendezvous hashing over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.operators.numbering import number_within


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the largest score w / -ln(u), where u in (0, 1) is a hash of key and shard (ties to the larger shard).

    A shard's score doesn't depend on the others, so adding one moves rows only into it, and taking one away moves only
    its own rows. A null key is hashed like any other value.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights: at least one shard, each with a weight above 0")
    shown = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    scores = []
    for shard, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(shown, F.lit(f"shard {shard}")), 11).cast("double")
        u = (bits + 0.5) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(float(weight)) / -F.ln(u)).alias("score"), F.lit(int(shard)).alias("shard")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return best["shard"].cast("int")


def shard_rows(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): where each row goes, its place there, and its shard under `grown`.

    size: UTF-8 bytes of the text plus 1, 1 for a null text, whose text_crc32 is that of no bytes. Law `key`: the id and
    the weights decide, so equal ids share a shard (repeated rows too, in slots of their own), and equal texts under
    different ids need not. slot counts from 0 in each shard without gaps; its order follows hashes of the ids. Only
    these few numbers are shuffled, never texts. No rows give none; other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = rows.withColumn("shard", rendezvous(F.col("doc_id"), weights))
    numbered = number_within(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    later = rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), later.alias("grown_shard"))
