"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Unicode White_Space, as the body of a character class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Column of numbered().
ROW = "_row"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, (doc_id bigint, text string): other columns can't clash with what an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir: without it there is none that driver and executors share."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    return place


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder, which outlive lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Store:
    """Intermediate tables of one run, as Parquet in the shared folder: they outlive lost executors, and their sizes are known.

    What is superseded can be dropped; what the result still reads stays until the folder is removed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.place, self.n = spark, os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}"), 0

    def put(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path = f"{self.place}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Removes the files of all tables but these, which the result still reads."""
        kept = {t._stored_at for t in tables}
        for n in range(self.n):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{n}")
            if f"{self.place}/{n}" not in kept:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key():
    """A 64-bit hash of doc_id and text. Rows that share both share what is found in them, so ids may be shared or missing."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def numbered(df: DataFrame) -> DataFrame:
    """df with a number for every row, in ROW, written to the shared folder so that it stays the same."""
    place = os.path.join(shared_folder(df.sparkSession), f"numbered-{uuid.uuid4().hex}")
    df.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(place)
    return df.sparkSession.read.parquet(place)


#: Caches of operators that this worker holds.
_HELD: list = []


def hold(cache=None) -> None:
    """For the start of a task: of the operators' caches its worker keeps this one, or none.

    Workers outlive tasks, and the next stage needs the memory of the last one's memos.
    """
    gone = [c for c in _HELD if c is not cache]
    _HELD[:] = [cache] if cache is not None else []
    for c in gone:
        c.cache_clear()
    if gone:
        gc.collect()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries keep freed memory until told
    if trim is not None:
        trim(0)


def rest_collector() -> None:
    """For workers that keep large memos: full passes of Python's cycle collector over them cost more than they find."""
    gc.set_threshold(200_000, 50, 1000)
