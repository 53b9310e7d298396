"""The questions over streams of files, with state in Spark's checkpoints."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.config import QueryConfig
from tallyhouse.operators import aggregate as A, filters as L, ranking as R
from tallyhouse.operators.dimensions import Dimension, lookup
from tallyhouse.sinks.result_files import filesystem
from tallyhouse.sources import ingest as I
from tallyhouse.streaming import keyed as K


def file_stream(spark: SparkSession, path: str, schema, source: str = "parquet", files: int | None = 4, size: int | None = None, archive: str | None = None) -> DataFrame:
    """Files in the order they came, at most so many, or about so many bytes (and one file at least), at a time.

    archive: a folder that files are moved to once a later batch has been committed, so that listing the source stays
    short. Rows of one batch come in no order; order_of_files() tells which file is the earlier one by name.
    """
    reader = spark.readStream.format(source).schema(schema)
    if size is not None:
        reader = reader.option("maxBytesPerTrigger", size)
    elif files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def order_of_files(df: DataFrame, name: str = "seq") -> DataFrame:
    """df of a file source with a column that orders rows by the names of their files, as readers of folders expect."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def without_repeats(df: DataFrame, keys: list[str], moment: str = "created_at", late: str | None = None) -> DataFrame:
    """Each key once, in whatever order rows come; every key is remembered. Rows with a null or empty key all stay.

    late, as "30 days": keys are forgotten after that time, and rows that come later than that are dropped. A query of
    it is to be started inside keyed.settings(), which puts the state in RocksDB; run_available() does so.
    """
    known = F.lit(True)
    for k in keys:
        known = known & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    some, rest = df.where(known), df.where(~known)
    if late is not None:
        some = some.withColumn("_moment", F.col(moment).cast("timestamp")).withWatermark("_moment", late).dropDuplicatesWithinWatermark(keys).drop("_moment")
    else:
        some = some.dropDuplicates(keys)
    return some.unionByName(rest)


def running_payment_value(df: DataFrame, config: QueryConfig = QueryConfig()) -> DataFrame:
    return A.payment_value(L.keep(df, L.year_in("created_at", config.years), L.time_between("created_at", config.start, config.end)))


def running_item_totals(df: DataFrame, config: QueryConfig = QueryConfig()) -> DataFrame:
    return A.item_totals(L.keep(df, L.year_in("created_at", config.years)))


def running_purchase_counts(df: DataFrame, config: QueryConfig = QueryConfig()) -> DataFrame:
    return A.purchase_counts(L.keep(df, L.year_in("created_at", config.years)))


def enriched(df: DataFrame, dim: Dimension, key: str, name: str) -> DataFrame:
    """A stream with the dimension's value for key; of repeated keys the last written counts, so rows never fan out."""
    return lookup(df, dim, key, name)


def start_available(df: DataFrame, folder: str, put: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Runs a stream over what there is, with put for each batch, and ends. Gives each batch's number and input rows."""
    with K.settings(df.sparkSession):
        query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return [{"batch": p.batchId, "rows": p.numInputRows} for p in query.recentProgress]


def run_available(df: DataFrame, folder: str, mode: str = "append", finish: Callable[[DataFrame], DataFrame] | None = None, per: tuple[str, ...] = ()) -> list[dict]:
    """Runs a stream over what there is and ends. Each batch overwrites its own folder, so a repeated batch leaves the same.

    mode update or complete: a batch holds changed or all totals. finish: applied to each batch, as a ranking. per:
    columns that have folders of their own in a batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        (finish(batch) if finish else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy(*per).parquet(f"{folder}/out/number={number}")

    return start_available(df, folder, put, mode)


def run_messages(stream: DataFrame, folder: str, entity: str, value: str = "value") -> list[dict]:
    """A stream of JSON batch messages into two tables below folder: rows, typed, and dead, what could not be read.

    dead has the text (of a message, or of a row as JSON), its client where known, and why. Both sides of a batch come
    from one reading of it, and are overwritten together when the batch is repeated.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows, dead = I.split_messages(batch, entity, value)
            rows.write.mode("overwrite").parquet(f"{folder}/rows/number={number}")
            dead.write.mode("overwrite").parquet(f"{folder}/dead/number={number}")
        finally:
            batch.unpersist()

    return start_available(stream.select(value), folder, put)


def run_ranking(counts: DataFrame, folder: str, per: list[str], key: str, by: str, n: int) -> list[dict]:
    """Keeps the n best keys of each group over running counts that only rise, and puts down what changes.

    A batch takes the counts that changed in it (update mode) and the ranking as it was, of at most n rows a group, and
    no others: a key that is not among them has the count it had, and was not among the best. Tables below folder:
    ranking/number=x, after each batch, of which the last two stay; out/number=x, rows of groups whose best changed,
    with their rank, null for keys that are no longer among the best.
    """
    columns = [*per, key, by, "rank"]

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*per, key, by).persist()
        before = kept_ranking(spark, folder, number, new.schema.add("rank", "integer"))
        try:
            both = new.unionByName(before.drop("rank")).groupBy(*per, key).agg(F.max(by).alias(by))
            best = R.top_n(both, per, by, n, then=[key])
            best = best.withColumn("rank", F.row_number().over(R.order_in(per, by, [key])).cast("int")).select(*columns)
            best.write.mode("overwrite").parquet(f"{folder}/ranking/number={number}")
            best = spark.read.parquet(f"{folder}/ranking/number={number}")
            left = before.join(best, [*per, key], "left_anti").withColumn("rank", F.lit(None).cast("int"))
            best.exceptAll(before.select(*columns)).unionByName(left.select(*columns)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")
            fs, root = filesystem(folder)
            with contextlib.suppress(FileNotFoundError):
                fs.delete_dir(f"{root}/ranking/number={number - 2}")
        finally:
            new.unpersist()

    return start_available(counts, folder, put, "update")


def kept_ranking(spark: SparkSession, folder: str, before: int | None = None, schema=None) -> DataFrame:
    """The ranking of run_ranking, as it was before a batch or is now."""
    found = I.listed(spark, f"{folder}/ranking", "*.parquet").select(F.regexp_extract("path", "number=([0-9]+)/", 1).cast("int").alias("number"))
    last = (found if before is None else found.where(F.col("number") < before)).agg(F.max("number")).first()[0]
    return spark.createDataFrame([], schema) if last is None else spark.read.parquet(f"{folder}/ranking/number={last}")


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """For each key, the row of the last batch that had it."""
    rows = spark.read.parquet(f"{folder}/out").drop("number")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("_r")).select(*keys, "_r.*").drop("batch")


def deliver(df: DataFrame, folder: str, keys: list[str]) -> None:
    """Puts each client's rows of a stream into its own folders, each of `keys` once, also over repeats and restarts."""
    run_available(without_repeats(df, ["client_id", *keys]), folder, per=("client_id",))


def delivered(spark: SparkSession, folder: str, client_id: str | None = None) -> DataFrame:
    """Rows that clients, or one of them, were given; of one client, no other's files are read."""
    rows = spark.read.option("basePath", f"{folder}/out").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/out").drop("number", "batch")
    return rows if client_id is None else rows.where(F.col("client_id") == client_id)


def run_barrier(df: DataFrame, folder: str, needed: int, parts: int = K.PARTS) -> list[dict]:
    """Sends (client_id, amount, n_rows) of each client once `needed` distinct completion markers came; what is there is run.

    Rows (client_id, kind, message_uuid, amount, seq) of kind data, EOF or CLIENT_RESET; seq gives their order, whatever
    file they come in. A reset voids what has a smaller seq; a repeated message_uuid counts once, its first by seq; data
    without one count each time. What came is kept as state by client (keyed.Barrier), goes when the client is sent, and
    is never read again from files. Rows of a client after its last marker wait for a reset. Senders send markers after
    their data. Gives each batch's number and input rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        totals = batch.groupBy("client_id", "since").agg(F.sum("amount").alias("amount"), F.sum("n_rows").alias("n_rows"))
        totals.select("client_id", "amount", "n_rows", "since").write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    return start_available(K.barrier(df, needed, parts), folder, put)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a run's state and output in spark.checkpoint.dir, which the cluster shares."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    return f"{place}/{name}-{uuid.uuid4().hex}"
