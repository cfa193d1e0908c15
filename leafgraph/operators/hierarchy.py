"""The folder tree: paths, listings, cycle checks, moves and deletions, for many folders at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.texts import is_blank, trim_ws
from leafgraph.operators.components import connected_components
from leafgraph.operators.numbering import number_rows
from leafgraph.operators.patches import fold_patches
from leafgraph.operators.tours import intervals, positions
from leafgraph.session import cut, release, shuffled

#: Steps up the tree after which a walk answers that there is no cycle; moves of one component that are decided at a time.
WALK, MOVES = 1_000, 2_000_000


def tree_order(folders: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders by (sort_order, name), files by (sort_order, title); equal ones by id."""
    return folders.orderBy("sort_order", "name", "id"), files.orderBy("sort_order", "title", "id")


def children_of(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(parent, folders, files): each folder's child ids in tree order; parent 0 is the root."""
    a = folders.groupBy(F.coalesce("parent_id", F.lit(0)).alias("parent")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "name", "id"))), lambda x: x["id"]).alias("folders"))
    b = files.groupBy(F.coalesce("folder_id", F.lit(0)).alias("parent")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "title", "id"))), lambda x: x["id"]).alias("files"))
    return a.join(b, "parent", "full")


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, name, parent_id, depth, breadcrumb) of the folders that can be reached from the root.

    Ways up double with each round, so there are about as many as the logarithm of the depth; a folder under a missing
    parent or on a circle is never reached. A breadcrumb holds all names above a folder; where only places or depths are
    wanted, tours.positions does without.
    """
    rows = cut(folders.select("id", "name", "parent_id").where("id is not null"))
    way = cut(rows.select("id", F.col("parent_id").alias("at"), F.array("name").alias("breadcrumb")))
    rounds = way.count().bit_length() + 1
    for _ in range(rounds):
        if way.where("at is not null").isEmpty():
            break
        on = way.select(F.col("id").alias("at"), F.col("at").alias("__at"), F.col("breadcrumb").alias("__above"))
        before, way = way, cut(way.where("at is not null").join(on, "at").select("id", F.col("__at").alias("at"), F.concat("__above", "breadcrumb").alias("breadcrumb")).unionByName(way.where("at is null")))
        release(before)
    found = way.where("at is null").select("id", "breadcrumb")
    return rows.join(found, "id").select("id", "name", "parent_id", (F.size("breadcrumb") - 1).alias("depth"), "breadcrumb")


def flatten_tree(folders: DataFrame, files: DataFrame, collapsed: DataFrame | None = None, keep_line: bool = False) -> DataFrame:
    """(is_file, id, name, depth) of the tree from top to bottom: in each folder its folders first, then its files.

    What is below a collapsed folder (id) is hidden. Files in no folder come after the top folders; files in a folder
    that can't be reached are left out. With keep_line the rows aren't sorted but have their line, from 1; lines of what is
    hidden are left free. The lines come from an Euler tour, in as many rounds as the logarithm of its length at most.
    """
    own = files.where("id is not null").select("id", "title", "folder_id", "sort_order")
    numbered = cut(number_rows(own, ["folder_id", "sort_order", "title", "id"], "n", 1))
    counts = cut(numbered.groupBy("folder_id").agg(F.count("*").alias("lines"), F.min("n").alias("low")))
    place = cut(positions(folders, counts.select(F.col("folder_id").alias("id"), "lines").where("id is not null"), collapsed))
    shut = (collapsed.select("id") if collapsed is not None else folders.select("id").limit(0)).distinct().withColumn("shut", F.lit(1))
    names = folders.select("id", "name").where("id is not null")
    rows = place.where("above = 0").join(names, "id").select(F.lit(0).alias("is_file"), "id", "name", F.col("depth").cast("int").alias("depth"), F.col("first").alias("line"))
    open_ones = place.where("above = 0").join(shut, "id", "left").where("shut is null").select(F.col("id").alias("folder_id"), "inner", "depth")
    inside = numbered.join(counts.select("folder_id", "low"), "folder_id").join(open_ones, "folder_id")
    rows = rows.unionByName(inside.select(F.lit(1).alias("is_file"), "id", F.col("title").alias("name"), (F.col("depth") + 1).cast("int").alias("depth"), (F.col("inner") + F.col("n") - F.col("low") + 1).alias("line")))
    last = place.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
    rows = rows.unionByName(numbered.where("folder_id is null").select(F.lit(1).alias("is_file"), "id", F.col("title").alias("name"), F.lit(0).alias("depth"), (F.col("n") + last).alias("line")))
    return rows if keep_line else rows.orderBy("line").drop("line")


def creates_cycle(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (id, new_parent, ...) with creates_cycle: the new parent is the folder itself or less than WALK steps below it, as the tree is now.

    A folder is above another if its lines in the tree's listing hold the other's, so each move takes two joins with the
    folders' places, however deep the tree is. On a circle of folders the way up also goes around it.
    """
    place = cut(intervals(folders))
    low = place.select(F.col("id").alias("new_parent"), F.col("circle").alias("__circle"), F.col("first").alias("__at"), F.col("depth").alias("__depth"), F.col("back_first").alias("__back"), F.col("back_depth").alias("__back_depth"))
    high = place.select("id", F.col("circle").alias("__own"), F.col("first").alias("__first"), F.col("last").alias("__last"), F.col("depth").alias("__top"))
    asked = moves.select("id", "new_parent").where("new_parent is not null and id is not null").distinct()
    j = asked.join(low, "new_parent", "left").join(high, "id", "left")
    holds = lambda c: (F.col("__first") <= F.col(c)) & (F.col(c) <= F.col("__last"))
    direct = holds("__at") & (F.col("__depth") - F.col("__top") < WALK)
    around = holds("__back") & (F.col("__depth") + 1 + F.col("__back_depth") - F.col("__top") < WALK)
    hit = (F.col("id") == F.col("new_parent")) | F.coalesce(F.col("__circle").eqNullSafe(F.col("__own")) & (direct | F.coalesce(around, F.lit(False))), F.lit(False))
    hits = j.where(hit).select("id", "new_parent", F.lit(True).alias("__hit"))
    return moves.join(hits, ["id", "new_parent"], "left").select(*[moves[c] for c in moves.columns], F.coalesce("__hit", F.lit(False)).alias("creates_cycle"))


def apply_folder_patches(folders: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders, rejected patches) after patches (seq, id, name, parent_id, move_to_root, sort_order), in order of seq.

    A patch that would make a cycle in the tree as it then is, is rejected whole; one of an unknown folder does nothing. A
    null field means unchanged, names are trimmed, and a patch that names a parent and the root means the root. seq should
    be unique: patches that share it are taken in order of id. Only moves depend on each other, and only those whose folders
    meet on some way up. The tree is contracted to the folders that are moved, by joins, folders that may meet are one
    component, and each component's moves are decided in order, in some task, all components side by side. Only those of
    components of more than MOVES moves are taken MOVES at a time, each time in the tree as it then is. Names and sort orders
    are then folded as those of files are.
    """
    known = folders.select("id", "parent_id").where("id is not null")
    root = F.coalesce("move_to_root", F.lit(False))
    wanted = patches.where(root | F.col("parent_id").isNotNull()).join(shuffled(known.select("id")), "id", "left_semi")
    moves = number_rows(wanted.select("seq", "id", F.when(~root, F.col("parent_id")).alias("target")), ["seq", "id"], "n", 0)
    moves = cut(moves)
    decided, large = _decide(known, moves)
    refused = cut(decided.where("refused").select("seq", "id"))
    tree, low, count = known, 0, large.count() if large is not None else 0
    if count:
        large = cut(number_rows(large.select("seq", "id", "target", F.col("n").alias("at")), ["at"], "n", 0).drop("at"))
    while low < count:
        decided = cut(_decide(tree, large.where((F.col("n") >= low) & (F.col("n") < low + MOVES)))[0])
        refused = refused.unionByName(decided.where("refused").select("seq", "id"))
        last = decided.where("not refused").groupBy("id").agg(F.max_by(F.struct("target"), "n").alias("last"))
        low += MOVES
        if low < count:
            tree = cut(tree.join(shuffled(last), "id", "left").select("id", F.when(F.col("last").isNotNull(), F.col("last.target")).otherwise(F.col("parent_id")).alias("parent_id")))
    refused = shuffled(cut(refused))
    kept = patches.join(refused, ["seq", "id"], "left_anti").select("seq", "id", F.col("name").alias("title"), F.col("parent_id").alias("folder_id"), "move_to_root", "sort_order")
    return _patched(folders, fold_patches(kept)), patches.join(refused, ["seq", "id"], "left_semi").select(patches.columns)


def _decide(tree: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """moves (n, seq, id, target) with `refused`: the walk up from the target meets the folder within WALK steps, as the tree is after the moves before it.

    Also the moves that aren't decided, if any: those of components that have more than MOVES of them.
    """
    moved = moves.select("id").distinct().withColumn("moves", F.lit(True))
    # (id, at, steps, open): the nearest folder at or above id that some move moves, null if there is none; open: still on the way.
    up = tree.join(shuffled(moved), "id", "left")
    above = moved.select(F.col("id").alias("parent_id"), F.lit(True).alias("above_moves"))
    known = tree.select(F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    up = up.join(shuffled(known), "parent_id", "left").join(shuffled(above), "parent_id", "left")
    on_way = F.col("moves").isNull() & F.col("there") & F.col("above_moves").isNull()
    up = up.select("id", F.when(F.col("moves"), F.col("id")).when(F.col("there"), F.col("parent_id")).alias("at"), F.when(F.col("moves"), 0).otherwise(1).alias("steps"), F.coalesce(on_way, F.lit(False)).alias("open"), "parent_id")
    up = cut(up)
    for _ in range(WALK.bit_length()):
        if up.where("open").isEmpty():
            break
        on = up.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("open").alias("further"))
        before, up = up, cut(up.where("open").join(shuffled(on), "at").select("id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("further").alias("open"), "parent_id").unionByName(up.where("not open")))
        release(before)
    near = shuffled(up.select(F.col("id").alias("from"), F.when(~F.col("open"), F.col("at")).alias("at"), "steps"))
    asked = moves.select("n", "seq", "id", "target", F.col("target").alias("from")).join(near, "from", "left").drop("from")
    first = up.join(shuffled(moved.select("id")), "id", "left_semi").select("id", F.col("parent_id").alias("from")).join(near, "from", "left")
    first = first.select(F.lit(-1).cast("long").alias("n"), F.lit(None).cast(moves.schema["seq"].dataType).alias("seq"), "id", F.lit(None).cast("long").alias("target"), "at", "steps")

    # Ways up meet only among folders that were or become linked: each component of these links is decided by itself.
    rows = cut(asked.select(first.columns).unionByName(first))
    links = rows.where("at is not null").select("id", "at").unionByName(moved.select("id", F.col("id").alias("at")))
    component = cut(connected_components(links, "id", "at", contract=True).select("id", "component"))
    rows = rows.join(shuffled(component), "id").select("component", "n", "id", "at", "steps")
    left = cut(rows.where("n >= 0").groupBy("component").agg(F.count("*").alias("count")).where(F.col("count") > MOVES).select("component"))
    large = None
    if not left.isEmpty():  # few: each has more than MOVES moves
        large = cut(moves.join(shuffled(rows.where("n >= 0").join(F.broadcast(left), "component", "left_semi").select("n")), "n", "left_semi"))
        rows = rows.join(F.broadcast(left), "component", "left_anti")
    rows = rows.repartition("component").sortWithinPartitions("component", "n")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        parent: dict[int, int | None] = {}  # the next moved folder above each
        more: dict[int, int] = {}  # and how many steps up from its parent, if any
        for batch in batches:
            numbers, refused = [], []
            for own_component, n, own, to, steps in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own_component != now:
                    now, parent, more = own_component, {}, {}
                walk, done, bad = to, steps or 0, False
                while n >= 0 and walk is not None and done < WALK:
                    if walk == own:
                        bad = True
                        break
                    done += 1 + more.get(walk, 0)
                    walk = parent.get(walk)
                if not bad:
                    parent[own] = to
                    if steps:
                        more[own] = steps
                    else:
                        more.pop(own, None)
                if n >= 0:
                    numbers.append(n)
                    refused.append(bad)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(refused, pa.bool_())], ["n", "refused"])

    return moves.join(shuffled(rows.mapInArrow(solve, "n long, refused boolean")), "n"), large


def _patched(folders: DataFrame, patches: DataFrame) -> DataFrame:
    p = patches.withColumnsRenamed({"id": "__id", "title": "__name", "place": "__place", "sort_order": "__sort"})
    j = folders.join(shuffled(p), F.col("id") == F.col("__id"), "left")
    parent = F.when(F.col("__place").isNotNull(), F.col("__place.folder_id")).otherwise(F.col("parent_id"))
    new = {"name": F.coalesce("__name", "name"), "parent_id": parent, "sort_order": F.coalesce("__sort", "sort_order")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in folders.columns])


def delete_folders(folders: DataFrame, files: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders, files) without the folders ids (id): what was in one moves up to its nearest ancestor that stays, or the root.

    What was below a cycle of folders all of which go, has no such ancestor and moves to the root. Each round doubles the
    steps that are done, so there are about as many as the logarithm of the number of folders that go.
    """
    gone = ids.select("id").distinct()
    up = cut(folders.join(gone, "id", "left_semi").select("id", F.col("parent_id").alias("target")))
    rounds = up.count().bit_length() + 1
    for _ in range(rounds):
        again = up.select(F.col("id").alias("target"), F.col("target").alias("__next"), F.lit(True).alias("__gone"))
        step = cut(up.join(again, "target", "left").select("id", F.when(F.col("__gone"), F.col("__next")).otherwise(F.col("target")).alias("target"), F.coalesce("__gone", F.lit(False)).alias("moved")))
        done = step.where("moved").isEmpty()
        up = step.drop("moved")
        if done:
            break
    circles = up.select(F.col("id").alias("target"), F.lit(True).alias("__circle"))  # who still stands at a folder that goes, goes around
    up = up.join(circles, "target", "left").select(F.col("id").alias("__id"), F.when(F.col("__circle").isNull(), F.col("target")).alias("__target"), F.lit(True).alias("__hit"))
    up = cut(up)

    def moved(df: DataFrame, column: str) -> DataFrame:
        j = df.join(up, F.col(column) == F.col("__id"), "left")
        return j.select(*[F.when(F.col("__hit"), F.col("__target")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns])

    return moved(folders.join(gone, "id", "left_anti").select(folders.columns), "parent_id"), moved(files, "folder_id")


def create_folders(folders: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new folders, rejected requests) of requests (seq, name, parent_id): blank names are rejected, others trimmed and numbered in order of seq."""
    ok = ~is_blank(F.col("name"))
    top = folders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("i"), F.coalesce(F.max("sort_order"), F.lit(0)).alias("s")).first()
    made = number_rows(requests.where(ok), ["seq"], "n")
    return made.select((F.col("n") + top["i"]).alias("id"), trim_ws(F.col("name")).alias("name"), "parent_id", (F.col("n") + top["s"]).cast("int").alias("sort_order")), requests.where(~ok)
