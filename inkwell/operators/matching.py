"""Joins by position: as-of, bounded look-back, containment, priority; and aggregates with fixed ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.storage import materialise


def asof_floor(points: DataFrame, starts: DataFrame, keys: Sequence[str], at: str, start: str, value: str, fallback_first: bool = True) -> DataFrame:
    """points with the value of the last start at or before them, of several equal starts the greatest value; before all starts the first one's, or null.

    Both sides are laid on one axis and the last start is carried forward: one shuffle by key and a sort, no pairs.
    """
    one = points.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(starts.schema[value].dataType).alias("__v"), F.struct(*points.columns).alias("__row"))
    two = starts.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "__v")
    both = one.unionByName(two)
    found = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if fallback_first:
        found = F.coalesce(found, F.first("__v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return both.withColumn("__found", found).filter("__side = 1").select("__row.*", F.col("__found").alias(value))


def asof_ceiling(points: DataFrame, starts: DataFrame, keys: Sequence[str], at: str, start: str, value: str, fallback_last: bool = True) -> DataFrame:
    """points with the value of the first start at or behind them; behind all starts the last one's, or null."""
    one = points.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(starts.schema[value].dataType).alias("__v"), F.struct(*points.columns).alias("__row"))
    two = starts.select(*keys, F.col(start).alias("__at"), F.lit(1).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "__v")
    found = F.first("__v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    if fallback_last:
        found = F.coalesce(found, F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return one.unionByName(two).withColumn("__found", found).filter("__side = 0").select("__row.*", F.col("__found").alias(value))


def bounded_lookback(points: DataFrame, starts: DataFrame, keys: Sequence[str], at: str, start: str, name: str, bound: int) -> DataFrame:
    """points with the last start at or before them that is at most bound away, else null."""
    found = asof_floor(points, starts.withColumn(name, F.col(start)), keys, at, start, name, fallback_first=False)
    return found.withColumn(name, F.when(F.col(at) - F.col(name) <= bound, F.col(name)))


def containing(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, order: str, disjoint: bool = False) -> DataFrame:
    """points with order of the first range that holds them, start <= at < end; null without one. Equal points stay as many as they are.

    disjoint: the ranges of a key don't overlap, so that the last one that begins at or before a point is the only candidate: no pairs.
    Else an equi-join by key, the ranges as residual.
    """
    if disjoint:
        held = ranges.filter(F.col(start) < F.col(end)).select(*keys, start, F.struct(F.col(order).alias("__order"), F.col(end).alias("__end")).alias("__range"))
        found = asof_floor(points, held, keys, at, start, "__range", fallback_first=False)
        return found.withColumn(order, F.when(F.col(at) < F.col("__range.__end"), F.col("__range.__order"))).drop("__range")
    counted = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("__n"))
    r = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(start).alias("__start"), F.col(end).alias("__end"), F.col(order).alias("__order"))
    cond = (F.col("__start") <= F.col(at)) & (F.col(at) < F.col("__end"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    found = counted.join(r, cond, "left").groupBy(*points.columns, "__n").agg(F.min("__order").alias(order))
    return found.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n")


def property_at(paragraphs: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str, bound: int = 2000) -> DataFrame:
    """paragraphs (start_cp, end_cp) with the value of a range (start_cp, end_cp): the one that holds the start; else the first that begins within the
    paragraph; else the last one before, its last place at most bound away; else the first of all, unless it begins more than bound behind.

    Ranges don't overlap. Two look-ups on one axis and a join by key, no pairs.
    """
    held = ranges.filter("start_cp < end_cp")
    known = held.select(*keys, F.col("start_cp").alias("__s"), F.struct(F.col("start_cp").alias("s"), F.col("end_cp").alias("e"), F.col(value).alias("v")).alias("__r"))
    rows = asof_floor(paragraphs, known, keys, "start_cp", "__s", "__r", fallback_first=False).withColumnRenamed("__r", "__before")
    rows = asof_ceiling(rows, known, keys, "start_cp", "__s", "__r", fallback_last=False).withColumnRenamed("__r", "__behind")
    rows = rows.join(known.groupBy(*keys).agg(F.min_by("__r", "__s").alias("__first")), list(keys), "left")
    b, n, first = F.col("__before"), F.col("__behind"), F.col("__first")
    here = F.when(b["e"] > F.col("start_cp"), b)
    within = F.when(n["s"] <= F.col("end_cp"), n)
    past = F.when(F.col("start_cp") - (b["e"] - 1) <= bound, b)
    found = F.coalesce(here, within, past, F.when(first["s"] <= F.col("start_cp") + bound, first))
    return rows.withColumn(value, found["v"]).drop("__before", "__behind", "__first")


def mode(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys and the most frequent value, of equally frequent ones the greatest. Two aggregates, both with partial sums."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(F.max(F.struct("__n", value)).alias("__m")).select(*keys, F.col(f"__m.{value}").alias(name), F.col("__m.__n").alias("n"))


def grid(cells: DataFrame, row: str, columns: Sequence[str], column: str, value: Column) -> DataFrame:
    """Every row name with each of a few named columns: values summed, zero where there are none.

    One aggregate with a sum per column, then unfolded, so that there is neither a cross join nor a second shuffle.
    """
    sums = [F.struct(F.lit(c).alias(column), F.coalesce(F.sum(F.when(F.col(column) == c, value)), F.lit(0.0)).alias("value")) for c in columns]
    return cells.groupBy(row).agg(F.array(*sums).alias("__all")).select(row, F.explode("__all").alias("__one")).select(row, f"__one.{column}", "__one.value")


def by_priority(left: DataFrame, right: DataFrame, on: Column, left_keys: Sequence[str], priority: Sequence[Column], picks: Sequence[str]) -> DataFrame:
    """left with the picked columns of the right row of least priority that on allows; nulls without one."""
    best = F.min(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], *picks))
    found = left.join(right, on, "left").groupBy(*left_keys).agg(best.alias("__b"))
    return found.select(*left_keys, *[F.col(f"__b.{c}").alias(c) for c in picks])


def ancestors(nodes: DataFrame, node: str, base: str, most: int | None = None) -> DataFrame:
    """node, ancestor, depth: itself at 0, then base by base, up to depth most if given. Doubles the reach each round, so a chain of n takes log n joins.

    Ends when a round finds no new pair, so that a cycle ends too: each of its nodes has all of them, at the least depth.
    """
    reach = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    step = nodes.filter(F.col(base).isNotNull()).select(F.col(node).alias("node"), F.col(base).alias("ancestor"), F.lit(1).alias("depth"))
    step = step.join(nodes.select(F.col(node).alias("ancestor")), "ancestor", "left_semi").select("node", "ancestor", "depth")
    both = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
    size = 1
    while most is None or size <= most:
        far = both(reach, step).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        new = materialise(far.join(reach, ["node", "ancestor"], "left_anti"))
        if not new.limit(1).count():
            break
        reach, step = reach.union(new), materialise(both(step, step))
        size *= 2
    return reach if most is None else reach.filter(F.col("depth") <= most)


def unrooted(nodes: DataFrame, node: str, base: str) -> DataFrame:
    """node of those whose chain of bases never ends: they are in a cycle, or inherit from one. A base that isn't a node ends a chain."""
    known = nodes.select(F.col(node).alias("__k"))
    roots = nodes.filter(F.col(base).isNull()).select(F.col(node).alias("ancestor"))
    loose = nodes.filter(F.col(base).isNotNull()).join(known, F.col(base) == F.col("__k"), "left_anti").select(F.col(node).alias("ancestor"))
    ended = ancestors(nodes, node, base).join(roots.union(loose), "ancestor", "left_semi").select(F.col("node").alias(node))
    return nodes.select(node).join(ended, node, "left_anti")
