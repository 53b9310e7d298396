"""A dimension that is kept: a table bucketed by key, with versions, to which deliveries are added.

A lookup in a table that is bucketed by its key needs no exchange on the dimension's side, and nothing is grouped again:
each version holds one row a key, the one written last. A delivery makes the next version, from the one before by a join
in its buckets; versions stay readable until dropped, so jobs that read one are not disturbed by the next.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.operators.filters import usable_dimension


class KeptDimension:
    """name: of its tables in the session's catalog, <name>_v1 and on. folder: where their files lie.

    Tables have the columns key, value and arrival, of which the greatest counts (then the greatest value).
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 16):
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError("a dimension's name has small letters, digits and _")
        self.spark, self.name, self.folder, self.buckets = spark, name, folder, buckets

    def versions(self) -> list[int]:
        found = (re.fullmatch(rf"{self.name}_v([0-9]+)", t.name) for t in self.spark.catalog.listTables())
        return sorted(int(m[1]) for m in found if m)

    def table(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        version = self.versions()[-1] if version is None else version
        return self.spark.table(f"{self.name}_v{version}")

    def deliver(self, df: DataFrame, key: str, value: str, arrival: str | Column) -> int:
        """Adds rows of (key, value) as they arrived; blank keys and values go. Gives the new version's number.

        Of the delivery, only its own rows are grouped and dealt by key; the version before is read in its buckets.
        """
        arrival = F.col(arrival) if isinstance(arrival, str) else arrival
        rows = usable_dimension(df, key, value).select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), arrival.cast("long").alias("arrival"))
        new = rows.groupBy("key").agg(F.max(F.struct(F.coalesce("arrival", F.lit(-(2**63))).alias("arrival"), "value")).alias("new"))
        versions = self.versions()
        if versions:
            old = self.table(versions[-1]).select(F.col("key").alias("_key"), F.struct("arrival", "value").alias("old"))
            new = old.join(new, F.col("_key") == F.col("key"), "full_outer").select(F.coalesce("key", "_key").alias("key"), F.greatest("old", "new").alias("new"))
        number = versions[-1] + 1 if versions else 1
        out = new.select("key", "new.value", "new.arrival").repartition(self.buckets, "key")
        out.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{self.name}_v{number}").saveAsTable(f"{self.name}_v{number}")
        return number

    def lookup(self, df: DataFrame, key: str | Column, name: str, default: str, version: int | None = None) -> DataFrame:
        """df with the newest (or a named) version's value for key as column name, default where there is none."""
        key = F.col(key) if isinstance(key, str) else key
        found = self.table(version).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
        return df.join(found, key.cast("string") == F.col("_key"), "left").withColumn(name, F.coalesce("_value", F.lit(default))).drop("_key", "_value")

    def drop_before(self, version: int) -> None:
        """Drops older versions with their files."""
        for v in self.versions():
            if v < version:
                self.spark.sql(f"drop table {self.name}_v{v}")
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.name}_v{v}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
