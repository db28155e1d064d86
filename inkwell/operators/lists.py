"""Numbering: overrides, effective levels, instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The glyphs that bullet levels fall back to.
BULLETS = ("·", "o", "▪")


def normalised_overrides(lists: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """key, override_id, list_id: given overrides, of equal ids the first (ord); then for each list its place in order as an id, and its own id, where free.

    lists: key, ord, list_id. Candidates are ranked by where they come from; the best of each id stays: one union, one aggregate.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    listed = lists.withColumn("__place", place).filter("list_id > 0")
    given = overrides.filter("override_id > 0").select(key, "override_id", "list_id", F.lit(0).alias("__from"), F.col("ord").alias("__ord"))
    by_place = listed.select(key, F.col("__place").cast("long").alias("override_id"), "list_id", F.lit(1).alias("__from"), (2 * F.col("__place")).alias("__ord"))
    by_id = listed.select(key, F.col("list_id").cast("long").alias("override_id"), "list_id", F.lit(1).alias("__from"), (2 * F.col("__place") + 1).alias("__ord"))
    every = given.withColumn("override_id", F.col("override_id").cast("long")).unionByName(by_place).unionByName(by_id)
    return every.groupBy(key, "override_id").agg(F.min_by("list_id", F.struct("__from", "__ord")).alias("list_id"))


def effective_levels(overrides: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """overrides (start_at, has_start, has_format) that change something: a start equal to the base level's counts as none."""
    base = levels.select(*keys, F.col("start_at").alias("__base"))
    real = F.col("has_start") & (F.col("start_at") > 0) & ~F.coalesce(F.col("__base") == F.col("start_at"), F.lit(False))
    return overrides.join(base, keys, "left").withColumn("has_start", real).filter(F.col("has_start") | F.col("has_format")).drop("__base")


def with_bullets(levels: DataFrame, keys: list[str], level: str, glyph: str) -> DataFrame:
    """levels with fallback glyphs, in the lists none of whose levels has a glyph of its own."""
    own = F.coalesce(~F.trim(glyph).isin("", BULLETS[0]), F.lit(False))
    some = F.max(own).over(Window.partitionBy(*keys))
    turn = F.element_at(F.array(*[F.lit(b) for b in BULLETS]), F.col(level) % len(BULLETS) + 1)
    return levels.withColumn(glyph, F.when(some, F.col(glyph)).otherwise(turn))


def used_definitions(overrides: DataFrame, used: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """key, override_id, list_id, format: each override that is used with its list's definition, decimal where that is missing."""
    wanted = overrides.join(used.select(key, "override_id").distinct(), [key, "override_id"], "left_semi")
    return wanted.join(definitions.select(key, "list_id", "format"), [key, "list_id"], "left").withColumn("format", F.coalesce("format", F.lit("Decimal"))).select(key, "override_id", "list_id", "format")
