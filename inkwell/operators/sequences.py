"""Operators on ordered rows. Every order is by explicit columns; every window is partitioned by the key of a document."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import running_sums
from inkwell.operators.matching import asof_floor

_SO_FAR = (Window.unboundedPreceding, 0)


def paragraphs(docs: DataFrame, key: str, text: Column, mark: str = "\n", start: Column | None = None) -> DataFrame:
    """key, para_idx, start_cp, end_cp, segment: a text cut at marks, the last part always given, in one row-wise pass.

    Positions come from running sums within the row's own array, in time that grows with the text, so that nothing is shuffled.
    start: where the text begins among the positions of its document (a textbox's story, say); 0 if not given.
    """
    parts = docs.select(key, (F.lit(0) if start is None else start).cast("long").alias("__start"), F.split(text, mark).alias("__parts"))
    begun = running_sums(F.transform("__parts", lambda p: F.length(p) + 1))
    rows = parts.select(key, "__start", F.posexplode(F.arrays_zip(F.col("__parts").alias("segment"), begun.alias("start"))).alias("para_idx", "p"))
    begin = F.col("__start") + F.col("p.start")
    return rows.select(key, "para_idx", begin.alias("start_cp"), (begin + F.length("p.segment")).alias("end_cp"), F.col("p.segment").alias("segment"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "island") -> DataFrame:
    """df with the number of the run of equal values that a row is in, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn(name, F.sum("__changed").over(w.rowsBetween(*_SO_FAR))).drop("__changed")


def nested_pairs(markers: DataFrame, keys: Sequence[str], order: Sequence[str], begins: Column, ends: Column) -> DataFrame:
    """keys, begin_at, end_at, level of pairs of begin and end marks as a stack makes them; order is one column; marks without partner have no pair.

    Level by running sum of +1 and -1; within a level an end belongs to the begin right before it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(begins, 1).when(ends, -1)
    rows = markers.withColumn("__k", step).filter("__k is not null").withColumn("__depth", F.sum("__k").over(w.rowsBetween(*_SO_FAR)))
    rows = rows.withColumn("level", F.when(F.col("__k") == 1, F.col("__depth")).otherwise(F.col("__depth") + 1))
    by_level = Window.partitionBy(*keys, "level").orderBy(*order)
    rows = rows.withColumn("__before", F.lag("__k").over(by_level)).withColumn("begin_at", F.lag(order[0]).over(by_level))
    return rows.filter((F.col("__k") == -1) & (F.col("__before") == 1)).select(*keys, "begin_at", F.col(order[0]).alias("end_at"), F.col("level").cast("long"))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null, of this row or one before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_SO_FAR)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def split_at(ranges: DataFrame, cuts: DataFrame, keys: Sequence[str], start: str, end: str, cut: str) -> DataFrame:
    """ranges with seg_start and seg_end: cut at the places that lie strictly inside them. Ranges may overlap, and equal rows are cut alike.

    An equi-join by key with the place as residual; where the ranges of a key don't overlap, segments() does it in one pass.
    """
    names = ranges.columns
    counted = ranges.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*names).orderBy("seg_start")
    on = [counted[k] == cuts[k] for k in keys] + [(cuts[cut] > counted[start]) & (cuts[cut] < counted[end])]
    inside = counted.join(cuts.dropDuplicates([*keys, cut]), on).select(*[counted[c] for c in counted.columns], cuts[cut].alias("seg_start"))
    points = counted.withColumn("seg_start", F.col(start)).unionByName(inside)
    cut_up = points.withColumn("seg_end", F.coalesce(F.lead("seg_start").over(own), F.col(end)))
    return cut_up.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n")


def segments(base: DataFrame, keys: Sequence[str], start: str, end: str, fields: Sequence[str], over: DataFrame | None = None, cuts: DataFrame | None = None, cut: str = "cut") -> DataFrame:
    """keys, start, end, base (struct of fields), over (struct of fields, null where no range of over lies): the elementary segments of base.

    Neither the ranges of base nor those of over may overlap each other. All boundaries are laid on one axis, and the open range of
    either side is carried forward: one shuffle and one sort, no pairs. cuts: further places to part at.
    """
    kind = F.struct(*fields)

    def marks(df: DataFrame, side: int) -> DataFrame:
        opens = df.select(*keys, F.col(start).alias("__at"), F.lit(1).alias("__open"), kind.alias("__v"))
        ends = df.select(*keys, F.col(end).alias("__at"), F.lit(0).alias("__open"), F.lit(None).cast(opens.schema["__v"].dataType).alias("__v"))
        return opens.unionByName(ends).withColumn("__side", F.lit(side))

    points = marks(base.filter(F.col(start) < F.col(end)), 0)
    if over is not None:
        points = points.unionByName(marks(over.filter(F.col(start) < F.col(end)), 1))
    if cuts is not None:
        none = F.lit(None).cast(points.schema["__v"].dataType)
        points = points.unionByName(cuts.select(*keys, F.col(cut).alias("__at"), F.lit(0).alias("__open"), none.alias("__v"), F.lit(2).alias("__side")))
    w = Window.partitionBy(*keys).orderBy("__at", "__open", "__side")
    state = lambda side: F.last(F.when(F.col("__side") == side, F.struct("__open", "__v")), ignorenulls=True).over(w.rowsBetween(*_SO_FAR))
    seen = points.select(*keys, "__at", F.lead("__at").over(w).alias("__to"), state(0).alias("__base"), state(1).alias("__over"))
    held = seen.filter("__to > __at and __base.__open = 1")
    return held.select(*keys, F.col("__at").alias(start), F.col("__to").alias(end), F.col("__base.__v").alias("base"), F.col("__over.__v").alias("over"))


def property_runs(ranges: DataFrame, keys: Sequence[str], start: str, end: str, fields: Sequence[str], marks: DataFrame, mark: str) -> DataFrame:
    """keys, start, end, special and fields: neighbouring ranges of equal fields (nulls are equal) joined into runs, each special mark a run by itself."""
    cuts = marks.select(*keys, F.col(mark).alias("cut")).unionByName(marks.select(*keys, (F.col(mark) + 1).alias("cut")))
    parts = segments(ranges, keys, start, end, fields, cuts=cuts)
    flags = marks.select(*keys, F.col(mark).alias(start)).distinct().withColumn("special", F.lit(True))
    parts = parts.join(flags, [*keys, start], "left").withColumn("special", F.coalesce("special", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(start)
    same = F.lag("base").over(w).eqNullSafe(F.col("base")) & (F.lag(end).over(w) == F.col(start)) & ~F.col("special") & ~F.lag("special").over(w)
    numbered_parts = parts.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(*_SO_FAR)))
    runs = numbered_parts.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.first("base").alias("base"), F.first("special").alias("special"))
    return runs.select(*keys, start, end, "special", "base.*")


def with_markers(runs: DataFrame, marks: DataFrame, paragraphs: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """keys, cp, kind (run, start, end), name: runs (already cut) and the markers of bookmarks in writing order.

    marks: name, start_cp, end_cp, ord. A marker stands before the run that begins at its place, starts before ends, each by ord; those at a
    paragraph's end stand behind its runs; in a paragraph without runs those at its start, then those at its end. paragraphs:
    start_cp, end_cp, para_idx.
    """
    both = [marks.select(*keys, F.col(f"{kind}_cp").alias("cp"), F.lit(kind).alias("kind"), "name", "ord", F.lit(rank).alias("rank")) for rank, kind in enumerate(("start", "end"))]
    placed = both[0].unionByName(both[1])
    own = runs.select(*keys, F.col("para_idx"), F.col(start).alias("cp"), F.lit("run").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("ord"), F.lit(2).alias("rank"))
    first = own.select(*keys, "para_idx", "cp", F.lit(0).alias("side")).distinct()
    empty = paragraphs.join(own.select(*keys, "para_idx").distinct(), [*keys, "para_idx"], "left_anti").select(*keys, "para_idx", F.col("start_cp").alias("cp"), F.lit(0).alias("side"))
    last = paragraphs.select(*keys, "para_idx", F.col("end_cp").alias("cp"), F.lit(1).alias("side"))
    closing = last.join(empty.select(*keys, "para_idx", "cp"), [*keys, "para_idx", "cp"], "left_anti")
    slots = first.unionByName(empty).unionByName(closing)
    found = slots.join(placed, [*keys, "cp"]).select(*keys, "para_idx", "cp", "kind", "name", "ord", "rank", "side")
    every = found.unionByName(own.withColumn("side", F.lit(0)))
    return numbered(every, [*keys, "para_idx"], ["cp", "side", "rank", "ord"], "pos").select(*keys, "para_idx", "pos", "cp", "kind", "name")


def merge_spans(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """df with island and span: the first row of a run gets the run's length, those that it covers get 0."""
    rows = islands(df, keys, order, value)
    own = Window.partitionBy(*keys, "island")
    first = F.row_number().over(own.orderBy(*order)) == 1
    return rows.withColumn("span", F.when(first, F.count(F.lit(1)).over(own)).otherwise(F.lit(0)).cast("long"))


def even_slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], slots: int) -> DataFrame:
    """df with slot: the items of a key dealt over slots in order, as evenly as can be."""
    w = Window.partitionBy(*keys).orderBy(*order)
    i, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__i", i).withColumn("__n", n).withColumn("slot", F.expr(f"(__i * {slots}) div __n").cast("long")).drop("__i", "__n")


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str, left_name: str, right_name: str) -> DataFrame:
    """keys, k, and the k-th of the left with the k-th of the right, as far as both go."""
    number = lambda df, order, name: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).select(*keys, F.col("k").cast("long").alias("k"), F.col(order).alias(name))
    return number(left, left_order, left_name).join(number(right, right_order, right_name), [*keys, "k"])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, base: int = 1) -> DataFrame:
    """df with a running number in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) + (base - 1)).cast("long"))


def first_seen_ids(df: DataFrame, keys: Sequence[str], same: Sequence[Column], order: str, name: str = "link_id") -> DataFrame:
    """df with one id for all rows that are the same, ids from 1 in order of first sight.

    The first place of each sort is an aggregate; only these are numbered.
    """
    labels = [f"__s{i}" for i in range(len(same))]
    rows = df.withColumns(dict(zip(labels, same, strict=True)))
    firsts = rows.groupBy(*keys, *labels).agg(F.min(order).alias("__first"))
    ids = numbered(firsts, keys, ["__first"], name).select(*[F.col(c).alias(f"__id_{c}") for c in [*keys, *labels]], name)
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__id_{c}")) for c in [*keys, *labels]])
    return rows.join(ids, on).select(*df.columns, name)


def reset_levels(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: Column) -> DataFrame:
    """df with island and parent: runs of one nesting level, and the latest run before it that is one level up.

    The runs of a level are looked up as of their number, level by level: no pairs.
    """
    rows = islands(df.withColumn("__level", level), keys, order, F.col("__level"))
    runs = rows.groupBy(*keys, "island").agg(F.first("__level").alias("__level"))
    wanted = runs.select(*keys, (F.col("__level") - 1).alias("__level"), "island")
    found = asof_floor(wanted, runs.withColumn("parent", F.col("island")), [*keys, "__level"], "island", "island", "parent", fallback_first=False)
    return rows.drop("__level").join(found.select(*keys, "island", "parent"), [*keys, "island"])


def descending(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """keys and whether the values, two at least and all numbers, fall strictly."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__v", value).withColumn("__falls", F.coalesce(F.col("__v") < F.lag("__v").over(w), F.row_number().over(w) == 1))
    return rows.groupBy(*keys).agg((F.bool_and("__falls") & (F.count("__v") == F.count(F.lit(1))) & (F.count(F.lit(1)) >= 2)).alias(name))


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int) -> DataFrame:
    """df with row_idx and col_idx: the rows of a key laid out width to a line."""
    rows = numbered(df, keys, order, "__i", 0)
    return rows.withColumn("row_idx", F.expr(f"__i div {width}").cast("long")).withColumn("col_idx", (F.col("__i") % width).cast("long")).drop("__i")


def page_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows of each key from offset on, limit of them, in order."""
    rows = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.filter((F.col("__at") > offset) & (F.col("__at") <= offset + limit)).drop("__at")
