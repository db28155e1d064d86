"""Helpers that the training-data operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import running_sums
from inkwell.storage import kept_bytes, kept_through, materialise, small_batches

__all__ = ["SPACES", "SPACE_RUN", "free_name", "hash_filter", "in_filter", "kept_bytes", "kept_through", "let", "materialise", "read", "running_sums", "small_batches", "span_string", "words"]

#: Fixed value: the characters that part words.
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: the same set as a Java pattern.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(base: str, *taken: list[str]) -> str:
    """A column name that begins with base and, whatever the case, is none of those taken."""
    used = {c.lower() for columns in taken for c in columns}
    while base.lower() in used:
        base += "_"
    return base


def hash_filter(rows: DataFrame, column: str, most_bits: int) -> tuple[bytes, int]:
    """A bit table of 64-bit hashes and the number of leading bits that address it: 64 bits a row, up to 2 ** most_bits in all.

    Built by an aggregate over blocks of 4 KB, so that the driver gets the table and never the hashes.
    """
    n_bits = min(most_bits, max(15, math.ceil(math.log2(64 * max(1, rows.count())))))
    place = F.shiftrightunsigned(column, 64 - n_bits)
    filled = rows.groupBy(F.expr(f"shiftrightunsigned(`{column}`, {64 - n_bits}) div 32768").alias("bucket")).agg(F.bitmap_construct_agg((place % 32768).cast("long")).alias("bits"))
    table = bytearray(1 << (n_bits - 3))
    for row in filled.collect():
        table[row.bucket * 4096 : (row.bucket + 1) * 4096] = row.bits
    return bytes(table), n_bits


def in_filter(hashes: np.ndarray, table: np.ndarray, n_bits: int) -> np.ndarray:
    """Which of the hashes (uint64) the table (its bytes) may hold."""
    place = (hashes >> np.uint64(64 - n_bits)).astype(np.int64)
    return ((table[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def words(text: Column) -> Column:
    """The words of a text: maximal runs of anything but SPACES."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def span_string(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined, of array<struct<start, kind, end>> whose kind is an index into kinds; sorts by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")
