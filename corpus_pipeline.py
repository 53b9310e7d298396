"""A corpus from documents to packed training sequences: five stages, each written and read again for the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm import minhash, packing, pii, suffix, toxicity
from tallyhouse.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by shingles of five words and a similarity of 0.8."""
    return minhash.keep_one(docs, width=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, and of 200 bytes, that start more than once go; every document stays."""
    return suffix.remove(docs, length=200, gram=96, words=50)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; every document stays."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens or a smaller power of two."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", remove_repeated_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learned models and suffix arrays are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with Parquet between them in the cluster's shared folder."""
    place = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}_{name}")
        docs = spark.read.parquet(f"{place}/{k}_{name}")
    return docs
