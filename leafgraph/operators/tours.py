"""Euler tours of forests, ranked as lists: places, extents and depths of all nodes without a step for each level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.operators.numbering import number_rows
from leafgraph.session import cut, release

#: Events of a list that are ranked within one task; `next` of a list's last event, and of one that leads nowhere.
PART, END, NOWHERE = 1_000_000, -1, -2


def list_sums(events: DataFrame, count: int, weights: list[str]) -> DataFrame:
    """(e, *weights) of the events (e, next, *weights) from which END is reached: weights are summed from the event to END.

    Events are numbered from 0 to count - 1. First each part of the numbers is contracted in a task: an event is led on to
    the first event outside of its part. Only events that another part leads to are then ranked by pointer doubling, in as
    many rounds as the logarithm of their number, and all others take one step more. So a list whose order is near that of
    its numbers takes few rounds however long it is, and one of up to PART events none. Events on a circle reach nothing.
    """
    parts = max(1, -(-count // PART))
    columns = ", ".join(f"{c} long" for c in ("e", "next", *weights))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([batch.column(i).to_numpy() for i in range(2 + len(weights))]) for batch in batches if batch.num_rows]
        if not held:
            return
        own = np.concatenate(held, axis=1)
        held.clear()
        own = own[:, np.argsort(own[0], kind="stable")]
        e, to, sums = own[0], own[1], own[2:]
        at = np.minimum(np.searchsorted(e, to), max(0, len(e) - 1))
        at = np.where(e[at] == to, at, -1) if len(e) else at
        for _ in range(len(e).bit_length() + 1):
            on = np.flatnonzero(at >= 0)
            if not len(on):
                break
            then = at[on]
            sums[:, on], to[on], at[on] = sums[:, on] + sums[:, then], to[then], at[then]
        to[at >= 0] = NOWHERE
        for low in range(0, len(e), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 100_000]) for c in own], ["e", "next", *weights])

    near = cut(events.select("e", "next", *weights).repartitionById(parts, F.floor(F.col("e") / PART).cast("int")).mapInArrow(contract, columns))
    ended = near.where(F.col("next") == END).select("e", *weights)
    if parts == 1:
        return ended
    far = near.where("next >= 0")
    entries = cut(near.join(far.select(F.col("next").alias("e")).distinct(), "e", "left_semi"))
    for _ in range(max(1, entries.count()).bit_length() + 1):
        if entries.where("next >= 0").isEmpty():
            break
        before, entries = entries, cut(_led_on(entries.where("next >= 0"), entries, weights).unionByName(entries.where("next < 0")))
        release(before)
    return ended.unionByName(_led_on(far, entries, weights).where(F.col("next") == END).select("e", *weights))


def _led_on(events: DataFrame, entries: DataFrame, weights: list[str]) -> DataFrame:
    """events, each led on by the entry that it leads to."""
    on = entries.select(F.col("e").alias("next"), F.col("next").alias("__to"), *[F.col(w).alias(f"__{w}") for w in weights])
    return events.join(on, "next").select("e", F.col("__to").alias("next"), *[(F.col(w) + F.col(f"__{w}")).alias(w) for w in weights])


def positions(folders: DataFrame, more: DataFrame | None = None, marked: DataFrame | None = None) -> DataFrame:
    """(id, first, last, inner, depth, above) of the folders (id, parent_id, sort_order, name) that can be reached from the top.

    The tree is listed from top to bottom, folders of one parent by (sort_order, name, id): first is a folder's line, from
    1, last that of the last line below it. more (id, lines): lines that come at the end of a folder, behind its folders,
    such as those of its files; inner is the line before them. depth is 0 at the top; above: how many folders above it, not
    itself, are `marked` (id). A folder under a missing parent or on a circle isn't reached.
    """
    rows = folders.select("id", "parent_id", "sort_order", "name").where("id is not null")
    f = cut(number_rows(rows, ["parent_id", "sort_order", "name", "id"], "n", 0))
    below = f.where("parent_id is not null").groupBy("parent_id").agg(F.min("n").alias("first"), F.max("n").alias("last")).withColumnRenamed("parent_id", "id")
    nodes = f.select("id", "n").join(below, "id", "left")
    count, tops = f.agg(F.count("*"), F.count_if(F.col("parent_id").isNull())).first()
    up = nodes.select(F.col("id").alias("parent_id"), F.col("n").alias("up"), F.col("last").alias("up_last"))
    j = f.select("id", "n", "parent_id").join(nodes.select("id", "first"), "id").join(up, "parent_id", "left")
    j = j.join(more.select("id", "lines"), "id", "left") if more is not None else j.withColumn("lines", F.lit(0))
    j = j.join(marked.select("id").distinct().withColumn("mark", F.lit(1)), "id", "left") if marked is not None else j.withColumn("mark", F.lit(0))
    enter, leave = F.col("n") * 2, F.col("n") * 2 + 1
    down = F.when(F.col("first").isNotNull(), F.col("first") * 2).otherwise(leave)
    sibling = F.when(F.col("parent_id").isNull(), F.when(F.col("n") < tops - 1, (F.col("n") + 1) * 2).otherwise(END)).when(F.col("up").isNull(), NOWHERE).when(F.col("n") < F.col("up_last"), (F.col("n") + 1) * 2).otherwise(F.col("up") * 2 + 1)
    event = lambda e, to, lines, depth, mark: F.struct(*[c.cast("long").alias(name) for name, c in (("e", e), ("next", to), ("lines", lines), ("depth", depth), ("mark", mark))])
    mark, lines = F.coalesce("mark", F.lit(0)), F.coalesce("lines", F.lit(0))
    events = j.select(F.explode(F.array(event(enter, down, F.lit(1), F.lit(1), mark), event(leave, sibling, lines, F.lit(-1), -mark))).alias("x")).select("x.*")
    sums = cut(list_sums(events, 2 * count, ["lines", "depth", "mark"]))
    total = sums.where("e = 0").select("lines").first()
    total = total[0] if total else 0
    side: Column = F.col("e") % 2
    both = sums.groupBy(F.floor(F.col("e") / 2).alias("n")).agg(*[F.max(F.when(side == k, F.col(c))).alias(f"{c}{k}") for c in ("lines", "depth", "mark") for k in (0, 1)])
    # A sum from here to the end is what is still to come; depth and marks still to be closed are those that are open.
    place = f.select("id", "n").join(both, "n").join(more.select("id", F.col("lines").alias("own")), "id", "left") if more is not None else f.select("id", "n").join(both, "n").withColumn("own", F.lit(0))
    inner = total - F.col("lines1")
    return place.select("id", (total - F.col("lines0") + 1).alias("first"), (inner + F.coalesce("own", F.lit(0))).alias("last"), inner.alias("inner"), (-F.col("depth0")).alias("depth"), (-F.col("mark0")).alias("above"))


def intervals(folders: DataFrame) -> DataFrame:
    """(id, circle, first, last, depth, back_first, back_depth) of all folders, for tests of what lies above what.

    Where circle is null, a folder is above another if its lines first to last hold the other's first. Folders under a
    missing parent count as top ones. A circle of folders is opened at its least id, which then is its top and names it;
    back_first and back_depth are those of the folder that this one lies in: from the top on, the way up goes on there.
    """
    known = folders.select(F.col("id").alias("parent_id"), F.lit(True).alias("__there"))
    rows = cut(folders.where("id is not null").join(known, "parent_id", "left").select("id", F.when(F.col("__there"), F.col("parent_id")).alias("parent_id"), "sort_order", "name"))
    place = cut(positions(rows))
    columns = ["id", "circle", "first", "last", "depth", "back_first", "back_depth"]
    none = lambda c: F.lit(None).cast("long").alias(c)
    plain = place.select("id", none("circle"), "first", "last", "depth", none("back_first"), none("back_depth"))
    rest = cut(rows.join(place.select("id"), "id", "left_anti").select(rows.columns))
    left = rest.count()
    if not left:
        return plain.select(columns)
    walk = rest.select("id", F.col("parent_id").alias("at"), F.col("id").alias("least"))
    for _ in range(left.bit_length()):
        on = walk.select(F.col("id").alias("at"), F.col("at").alias("__at"), F.col("least").alias("__least"))
        walk = cut(walk.join(on, "at").select("id", F.col("__at").alias("at"), F.least("least", "__least").alias("least")))
    around = walk.join(walk.select(F.col("at").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("at"), F.col("least").alias("circle"))
    named = cut(walk.select("id", "at").join(around, "at").select("id", "circle"))
    opened = rest.join(named, "id").select("id", "circle", F.when(F.col("id") != F.col("circle"), F.col("parent_id")).alias("parent_id"), "sort_order", "name")
    inside = cut(positions(opened).join(named, "id"))
    back = rest.select(F.col("id").alias("circle"), F.col("parent_id").alias("__back")).join(inside.select(F.col("id").alias("__back"), F.col("first").alias("back_first"), F.col("depth").alias("back_depth")), "__back")
    return plain.select(columns).unionByName(inside.join(back.drop("__back"), "circle").select(columns))
