"""Chat formatting after the collapse of cumulative snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Fixed value: the template of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def with_prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns with pos (from 1) and the rolling digest (s1, s2) of the first pos turns of a conversation.

    A digest is a sum over the turns so far of two hashes of (pos, role, text), so that a prefix is reached by adding.
    Turns stand by turn, then role, then text, nulls first. A long conversation is cut into blocks of turn numbers, sorted and
    summed by themselves; only block sums, one row a block, meet per conversation.
    """
    rows = turns.withColumn("__block", F.coalesce(F.expr(f"turn div {block}"), F.lit(-1 << 62)))
    within = Window.partitionBy("conv_id", "__block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    earlier = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda df, names: df.select("conv_id", "__block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in names])
    key = (F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))) & (F.col("a.__block") == F.col("b.__block"))
    join = lambda a, b, *more: a.alias("a").join(b.alias("b"), key).select("a.*", *more)
    counts = sums(rows.groupBy("conv_id", "__block").agg(F.count(F.lit(1)).alias("n")), ["n"])
    rows = join(rows.withColumn("__at", F.row_number().over(within)), counts, "b.__n").withColumn("pos", (F.col("__at") + F.col("__n")).cast("long"))
    for k, seed in (("h1", 11), ("h2", 23)):
        rows = rows.withColumn(k, F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)"))
    before = sums(rows.groupBy("conv_id", "__block").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2")), ["h1", "h2"])
    running = Window.partitionBy("conv_id", "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = join(rows.withColumn("__s1", F.sum("h1").over(running)).withColumn("__s2", F.sum("h2").over(running)), before, "b.__h1", "b.__h2")
    return rows.select("conv_id", "pos", "turn", "role", "text", (F.col("__s1") + F.col("__h1")).cast("decimal(38,0)").alias("s1"), (F.col("__s2") + F.col("__h2")).cast("decimal(38,0)").alias("s2"))


def maximal(prefixed: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_equal of the conversations that no longer one begins with; of equal ones the least conv_id.

    Whole conversations and their prefixes are counted by digest, so that a hot conversation shrinks before any shuffle.
    """
    whole = prefixed.groupBy("conv_id").agg(F.max(F.struct("pos", "s1", "s2")).alias("w")).select("conv_id", F.col("w.pos").alias("pos"), F.col("w.s1").alias("s1"), F.col("w.s2").alias("s2"))
    full = whole.groupBy("pos", "s1", "s2").agg(F.count(F.lit(1)).alias("n_equal"), F.min("conv_id").alias("conv_id"))
    begun = prefixed.groupBy("pos", "s1", "s2").agg(F.count(F.lit(1)).alias("n_begun"))
    longer = full.join(begun, ["pos", "s1", "s2"]).filter("n_begun > n_equal").select("pos", "s1", "s2")
    return full.join(longer, ["pos", "s1", "s2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_equal")


def formatted(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, n_equal, text: the maximal conversations, rendered whole.

    turns: conv_id, turn, role, text; other columns are left aside. A null role reads "unknown", a null text is empty. A
    null conv_id is a conversation like any other. Repeated rows are repeated turns. An empty table has no conversations.
    Turns are sorted in blocks of `block` turns; only rendered blocks meet in the task that joins a conversation's text.
    """
    prefixed = with_prefixes(turns.select("conv_id", "turn", "role", "text"), block)
    keep = maximal(prefixed)
    chosen = prefixed.alias("p").join(keep.alias("k"), F.col("p.conv_id").eqNullSafe(F.col("k.conv_id"))).select("p.conv_id", "pos", "role", "text", "n_turns", "n_equal")
    one = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), "").alias("t")
    parts = chosen.select("conv_id", "n_turns", "n_equal", F.expr(f"(pos - 1) div {block}").alias("part"), F.struct("pos", one.alias("t")).alias("one"))
    parts = parts.groupBy("conv_id", "n_turns", "n_equal", "part").agg(joined("one"))
    whole = parts.groupBy("conv_id", "n_turns", "n_equal").agg(joined(F.struct("part", "t")))
    return whole.select("conv_id", "n_turns", "n_equal", F.col("t").alias("text"))
