"""Intermediate results in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a Python worker of an intermediate result.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the setting is absent, a temporary one on one machine (master local, as in tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept_through(spark: SparkSession, write: Callable[[str], None]) -> str:
    """A new path in the shared folder, after write(path). The files outlive lost executors and go when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/inkwell-{uuid.uuid4().hex}"
    write(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def kept_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """The path of a file of that name with these bytes in a new folder of the shared folder."""

    def write(folder: str) -> None:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name)
        out = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jpath)
        for at in range(0, len(data), 1 << 24):
            out.write(bytearray(data[at : at + (1 << 24)]))
        out.close()

    return f"{kept_through(spark, write)}/{name}"


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """While it runs, Python stages get Arrow batches of at most so many bytes, or fewer where the session says so."""
    before = spark.conf.get(_BATCH, None)
    if before is None or not before.isdigit() or int(before) > most:
        spark.conf.set(_BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    with small_batches(df.sparkSession):
        path = kept_through(df.sparkSession, df.write.parquet)
    return df.sparkSession.read.schema(df.schema).parquet(path)
