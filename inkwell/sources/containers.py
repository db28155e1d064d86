"""Files of documents as a source: one row a file, with its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of a zip package and of a compound file.
ZIP, COMPOUND = bytes.fromhex("504B0304"), bytes.fromhex("D0CF11E0A1B11AE1")
MOST_BYTES = 100 << 20


def input_kind(content: Column, name: Column) -> Column:
    """docx or doc by the first bytes, else by the name's ending, else unknown."""
    starts = lambda magic: F.startswith(content, F.lit(magic))
    low = F.lower(name)
    return (
        F.when(starts(ZIP), F.lit("docx")).when(starts(COMPOUND), F.lit("doc")).when(F.endswith(low, F.lit(".docx")), F.lit("docx")).when(F.endswith(low, F.lit(".doc")), F.lit("doc")).otherwise(F.lit("unknown"))
    )


def files(spark: SparkSession, path: str, recursive: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length, content of the .doc and .docx files of a folder, whatever the case of their names.

    Larger ones (0: no limit) are left out by their length, which the source filters before it reads content; rejected() has them.
    """
    found = _listed(spark, path, recursive)
    return (found.filter(F.col("length") <= most_bytes) if most_bytes else found).select("path", "length", "content")


def rejected(spark: SparkSession, path: str, recursive: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length and reason of what files() leaves out; content isn't read."""
    found = _listed(spark, path, recursive).filter(F.col("length") > most_bytes) if most_bytes else _listed(spark, path, recursive).limit(0)
    return found.select("path", "length", F.lit("FileTooLarge").alias("reason"))


def _listed(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).filter(F.lower("path").rlike(r"\.docx?$"))
