"""python -m inkwell.cli IN OUT: the .doc and .docx files of a folder, or one file, as packages below OUT, with a table of results in OUT/_results.

Exit 0: all done; 1: IN is missing, holds no such file, or is OUT; 2: some file failed. A file that fails doesn't stop the others.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.options import Options
from inkwell.sinks import packages
from inkwell.sources.containers import files, input_kind, rejected
from inkwell.storage import materialise


def converted(found: DataFrame, options: Options | None = None) -> DataFrame:
    """path, docx, error, diagnostics of files (path, content): packages pass as they are, word files are decoded and written anew, others fail."""
    kinds = found.withColumn("kind", input_kind(F.col("content"), F.col("path")))
    made = packages.convert(kinds.filter("kind = 'doc'"), options)
    plain = lambda docx, error: [docx.alias("docx"), error.cast("string").alias("error"), F.lit(None).cast(made.schema["diagnostics"].dataType).alias("diagnostics")]
    same = kinds.filter("kind = 'docx'").select("path", *plain(F.col("content"), F.lit(None)))
    other = kinds.filter("kind = 'unknown'").select("path", *plain(F.lit(None).cast("binary"), F.lit("UnsupportedFormat")))
    return same.unionByName(made).unionByName(other)


def fault_of_paths(source: str, target: str) -> str | None:
    """What is wrong with the paths of a conversion, if anything."""
    if not source.strip() or not target.strip():
        return "a path is blank"
    if not os.path.exists(source):
        return f"missing: {source}"
    if os.path.abspath(source).lower() == os.path.abspath(target).lower():
        return "input and output are the same"
    return None


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("-r", "--recursive", action="store_true")
    parser.add_argument("-p", "--password")
    parser.add_argument("--no-links", action="store_true")
    args = parser.parse_args(argv)
    if wrong := fault_of_paths(args.source, args.target):
        print(wrong, file=sys.stderr)
        return 1
    options = Options(password=args.password, links=not args.no_links)
    spark = SparkSession.builder.getOrCreate()
    rows = materialise(converted(files(spark, args.source, args.recursive, options.most_bytes), options))
    source = os.path.abspath(args.source if os.path.isdir(args.source) else os.path.dirname(args.source) or ".")
    saved = packages.saved(rows, source, os.path.abspath(args.target))
    large = rejected(spark, args.source, args.recursive, options.most_bytes)
    results = rows.select("path", "error", "diagnostics").join(saved, "path").unionByName(large.select("path", F.col("reason").alias("error")), allowMissingColumns=True)
    results.write.mode("overwrite").parquet(os.path.join(args.target, "_results"))
    found = spark.read.parquet(os.path.join(args.target, "_results")).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
    print(f"{found.n - found.failed} of {found.n} files")
    return 1 if not found.n else 2 if found.failed else 0


if __name__ == "__main__":
    sys.exit(main())
