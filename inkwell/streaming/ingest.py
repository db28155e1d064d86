"""Incremental ingest: new files of a folder are decoded once, each by itself; what can't be has a row that says why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.sources import word
from inkwell.sources.containers import MOST_BYTES


def ingested(files: DataFrame, most_bytes: int = MOST_BYTES, password: str | None = None) -> DataFrame:
    """The relations of files (path, length, content): word files up to most_bytes decoded; larger ones failed as FileTooLarge, packages as UnsupportedFormat, neither read."""
    doc, fits = F.lower("path").rlike(r"\.doc$"), F.col("length") <= most_bytes
    made = word.decode(files.filter(doc & fits).select("path", "content"), password=password)
    reason = F.when(~fits, F.lit("FileTooLarge")).otherwise(F.lit("UnsupportedFormat"))
    left = files.filter(F.lower("path").rlike(r"\.docx?$") & ~(doc & fits)).select("path", F.lit("failed").alias("status"), reason.alias("error"))
    return made.unionByName(left, allowMissingColumns=True)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, most_bytes: int = MOST_BYTES, password: str | None = None) -> StreamingQuery:
    """Starts the decoding of what is new in a folder since the last call with this checkpoint, and ends when it is done.

    Stateless: a file is one row in and one out, so there is nothing to keep but the list of files seen. Each batch writes a folder of
    its own, anew if it is repeated, so that a file has one row whatever is lost.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        ingested(batch, most_bytes, password).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
