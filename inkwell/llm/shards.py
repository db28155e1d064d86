"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from inkwell.llm.common import kept_through

SHARDS, SEED, BUCKET_BYTES = 16, 20_240_917, 64 << 20
#: An identity that more than this share of all records have in common, and more than LEAST_COPIES, is dealt copy by copy; there are at most as many such identities.
HEAVY_IDENTITIES, LEAST_COPIES = 1000, 10_000


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _copies(records: DataFrame, identity: list[str], total: int, least: int) -> DataFrame:
    """records with __copy: 0, but for identities with very many records, whose records are numbered, so that each can go its own way.

    Which of these records gets which number doesn't matter, as each number comes up once. They are numbered within their input partitions,
    from where the partitions before end, so that no task sees more of one identity than a partition holds.
    """
    key = F.xxhash64(*identity)
    counts = records.groupBy(key.alias("__h")).agg(F.count(F.lit(1)).alias("__c"))
    heavy = [r["__h"] for r in counts.filter(F.col("__c") > max(least, total // HEAVY_IDENTITIES)).select("__h").collect()]
    if not heavy:
        return records.withColumn("__copy", F.lit(0).cast("long"))
    rows = records.withColumns({"__h": key, "__part": F.spark_partition_id()})
    many = rows.filter(F.col("__h").isin(heavy))
    before = many.groupBy("__h", "__part").agg(F.count(F.lit(1)).alias("__c"))
    before = before.select("__h", "__part", F.coalesce(F.sum("__c").over(Window.partitionBy("__h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    own = F.row_number().over(Window.partitionBy("__h", "__part").orderBy(F.lit(0))) - 1
    numbered = many.withColumn("__at", own).join(before, ["__h", "__part"]).withColumn("__copy", (F.col("__at") + F.col("__from")).cast("long"))
    few = rows.filter(F.coalesce(~F.col("__h").isin(heavy), F.lit(True))).withColumn("__copy", F.lit(0).cast("long"))
    columns = [*records.columns, "__copy"]
    return few.select(columns).union(numbered.select(columns))


def shuffled(records: DataFrame, identity: list[str], size: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least_copies: int = LEAST_COPIES) -> DataFrame:
    """records with shard and slot, by the law of rows: shards' counts differ by one at most.

    Pass one deals the records evenly into buckets by a seeded hash of the identity columns, each bucket a partition of its
    own of about bucket_bytes. Pass two shuffles each bucket by Fisher-Yates (Spark's seeded shuffle()), from a sorted start, so
    that the same records get the same order whatever the partitioning of the input. Buckets one after another give the
    global order, which is cut into even runs. Only bucket counts, a few bytes each, meet in one place.

    Nulls count as values of the hash; records equal in every column are interchangeable; very many records of one identity are
    dealt one by one, so that they spread over all buckets (identity has to be all columns then, or which of them goes where would
    depend on the input's partitioning). An empty table stays empty.
    Columns named shard or slot give way to the outputs. Partitions come out as the buckets, in global order.

    records are read several times, so they must be the same each time; what isn't is to be materialised before.
    """
    records = records.drop("shard", "slot")
    total = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    buckets = max(shards, math.ceil(total.b / bucket_bytes))
    way = F.when(F.col("__copy") == 0, F.xxhash64(F.lit(seed), *identity)).otherwise(F.xxhash64(F.lit(seed), *identity, "__copy"))
    dealt = _copies(records, identity, total.n, least_copies).select(F.pmod(way, F.lit(buckets)).cast("int").alias("__bucket"), F.struct(*identity, *[c for c in records.columns if c not in identity]).alias("__record"))
    begins = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__begin", F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    begins = begins.select(F.col("__bucket").alias("__b"), F.coalesce("__begin", F.lit(0)).alias("__begin"))
    mixed = dealt.repartitionById(buckets, F.col("__bucket")).groupBy("__bucket").agg(F.sort_array(F.collect_list("__record")).alias("__all"))
    mixed = mixed.select("__bucket", F.posexplode(F.shuffle("__all", seed)).alias("__at", "__one"))
    # one row of two numbers a bucket of bucket_bytes
    begins = F.broadcast(begins)
    position, n = F.col("__begin") + F.col("__at"), F.lit(max(1, total.n))
    shard = F.expr(f"cast((__begin + __at) * {shards} div {max(1, total.n)} as int)")
    placed = mixed.join(begins, F.col("__bucket") == F.col("__b")).withColumn("shard", shard)
    slot = (position - F.expr(f"(cast(shard as bigint) * {max(1, total.n)} + {shards - 1}) div {shards}")).cast("long")
    return placed.select(*[F.col("__one")[c].alias(c) for c in records.columns], "shard", slot.alias("slot"))


def write_shards(records: DataFrame, path: str, text: str = "text", identity: list[str] | None = None, **options) -> None:
    """Write whole records as one folder of Parquet files per shard, files (by name) and rows in slot order.

    A bucket is a run of slots, so that its task writes it where it was shuffled, without another exchange.
    """
    size = "__size"
    out = shuffled(records.withColumn(size, byte_size(records[text])), identity or [c for c in records.columns], size, **options).drop(size)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def documents_sharded(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, told from the written shards of their whole texts."""
    spark, records = documents.sparkSession, documents.select("doc_id", "text")
    path = kept_through(spark, lambda p: write_shards(records, p, identity=["doc_id", "text"]))
    schema = StructType([*records.schema, StructField("slot", LongType()), StructField("shard", IntegerType())])
    out = spark.read.schema(schema).parquet(path)
    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return out.select("doc_id", byte_size(out["text"]).alias("size"), digest, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
