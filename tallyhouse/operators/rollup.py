"""Totals kept over files that come, change and go: partial totals by file, of which only changed ones are made again.

Tables below a folder: partials/file=<digest of the path>, sums by the caller's keys of one source file, and its stamp;
listing/number=N, the files as they were found, which stays the same whatever executor is lost; manifest/number=N, the
files that count, written after their partials. A file that changed replaces its own partials and
no others, by dynamic partition overwrite. If a run is lost between the two writes, the next one does the same again.
Partials that no manifest row names with the same stamp do not count: files that are gone, or that have no rows left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.operators.aggregate import merge_partials
from tallyhouse.sources.ingest import listed

MANIFEST = "path string, file string, stamp string"
#: Bytes of partials that a task adds up at most, about.
PART = 32 << 20


def manifest(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """(number, (path, file, stamp)) of the newest manifest; -1 and no rows before the first."""
    numbers = listed(spark, f"{folder}/manifest", "*.parquet").select(F.regexp_extract("path", "number=([0-9]+)/", 1).cast("int").alias("n"))
    last = numbers.agg(F.max("n")).first()[0]
    return (-1, spark.createDataFrame([], MANIFEST)) if last is None else (last, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/number={last}"))


def present(spark: SparkSession, source: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, file, stamp) of the source's files; stamp changes with a file's length or time."""
    files = listed(spark, source, pattern)
    return files.select("path", F.md5("path").alias("file"), F.concat_ws("-", F.col("length"), F.unix_micros("modificationTime")).alias("stamp"))


def refresh(spark: SparkSession, source: str, folder: str, partial: Callable[[DataFrame], DataFrame], read: Callable[[list[str]], DataFrame] | None = None, pattern: str = "*.parquet", at_once: int = 10_000, size: int = 1 << 30) -> int:
    """Brings the partials of a source's files up to date, and gives the number of files that were read.

    partial: from rows with the column file to partial totals by file and the caller's keys. Changed files are read in
    turns of about at_once files, whose paths the driver lists, or size bytes; all others are not opened. Partials of a
    large file are written by several tasks.
    """
    number, known = manifest(spark, folder)
    listing = f"{folder}/listing/number={number + 1}"
    present(spark, source, pattern).write.mode("overwrite").parquet(listing)
    now = spark.read.schema(MANIFEST).parquet(listing)
    changed = now.join(known, ["path", "file", "stamp"], "left_anti")
    files, length = changed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.split("stamp", "-")[0].cast("long")), F.lit(0))).first()
    turns, done = max(-(-files // at_once), min(files, -(-length // size))), 0
    for turn in range(turns):
        some = changed.where(F.pmod(F.xxhash64("path"), F.lit(turns)) == turn).select("path", "file", "stamp")
        paths = [r["path"] for r in some.collect()]  # about at_once
        if paths:
            rows = (read or (lambda p: spark.read.parquet(*p)))(paths)
            sums = partial(rows.withColumn("file", F.md5(F.col("_metadata.file_path")))).join(some.select("file", "stamp"), "file")
            sums.hint("rebalance", "file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(f"{folder}/partials")
            done += len(paths)
    now.write.mode("overwrite").parquet(f"{folder}/manifest/number={number + 1}")
    return done


def totals(spark: SparkSession, folder: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Totals by keys of the files that the newest manifest names; no source file is read."""
    _, counted = manifest(spark, folder)
    try:
        partials = spark.read.parquet(f"{folder}/partials")
    except AnalysisException as e:  # nothing has had rows yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise ValueError(f"{folder} holds no partial totals") from e
    partials = partials.join(counted.select("file", "stamp"), ["file", "stamp"], "left_semi")
    length = listed(spark, f"{folder}/partials", "*.parquet").agg(F.sum("length")).first()[0] or 0
    parts = -(-length // PART)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        partials = partials.repartition(parts, *keys)
    return merge_partials(partials, keys, sums)
