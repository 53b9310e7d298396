"""Reading the entities: text columns first, then trimmed and typed, with rejects set apart instead of failing a job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tallyhouse.config import QueryConfig
from tallyhouse.functions import columns as C
from tallyhouse.sources.schemas import ENTITIES, FACTS, REQUIRED, ZERO


def text_schema(entity: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in ENTITIES[entity]])


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, modificationTime, length) of the files in and below a folder, from any file system; none where it is missing."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long")


def read_csv(spark: SparkSession, folder: str, entity: str, reduced: bool | QueryConfig = False, client_id: str | None = None) -> DataFrame:
    """All CSV files of <folder>/<entity> as text columns, by header. A missing folder gives no rows.

    reduced, or a config that says so: facts come from files ending in 01.csv alone. Folders client_id=x below it become
    a column; client_id sets it.
    """
    reduced = reduced.reduced if isinstance(reduced, QueryConfig) else reduced
    glob = "*01.csv" if reduced and entity in FACTS else "*.csv"
    try:
        df = spark.read.option("header", True).option("pathGlobFilter", glob).option("recursiveFileLookup", False).csv(f"{folder}/{entity}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        df = spark.createDataFrame([], text_schema(entity))
    df = cleaned(df)
    for c in ENTITIES[entity]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if client_id is not None:
        df = df.withColumn("client_id", F.lit(client_id))
    return df


def cleaned(df: DataFrame) -> DataFrame:
    """Names and text values without blanks around them."""
    return df.select(*[(F.trim(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name.strip()) for f in df.schema])


def _typed(entity: str, name: str, kind: str) -> Column:
    empty_as_zero = name in ZERO.get(entity, ())
    blank = F.coalesce(F.col(name), F.lit("")) == ""
    if name == "voucher_id":
        return F.nullif(C.safe_double(name, None), F.lit(0.0))
    if kind == "double":
        value = C.fixed_point(C.safe_double(name, None))
        return F.when(blank, 0.0).otherwise(value) if empty_as_zero else value
    if kind in ("int", "bigint"):
        value = C.safe_double(name, None).try_cast("bigint") if name == "user_id" else C.safe_long(name, 0, -1)
        value = F.when(value >= 0, value).try_cast(kind)
        return F.when(blank, F.lit(0).cast(kind)).otherwise(value) if empty_as_zero else value
    if kind == "date":
        return C.safe_date(name)
    if kind == "timestamp_ntz":
        return C.iso_timestamp(name)
    return F.col(name)


def rules(entity: str) -> dict[str, Column]:
    """Of a typed row, what each rule's failing looks like: <column> is unreadable or missing."""
    return {f"{c}: not a {ENTITIES[entity][c]}": F.col(c).isNull() for c in (*REQUIRED[entity], *ZERO.get(entity, ()))}


def judged(df: DataFrame, entity: str, observation: Observation | None = None) -> DataFrame:
    """Typed columns of the entity, those of KEPT that df has, _text, the row as it came, and _failed, the rules it fails.

    Moments of facts stay text, since the questions read them by different rules. observation: gets the number of rows
    and of each rule's failures, under r0, r1 and so on in the order of rules(), as the rows pass by.
    """
    extra = [c for c in df.columns if c not in ENTITIES[entity] and c in KEPT]
    rows = df.select(*[_typed(entity, c, t).alias(c) for c, t in ENTITIES[entity].items()], *extra, F.struct(*df.columns).alias("_text"))
    failed = rules(entity)
    rows = rows.withColumn("_failed", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in failed.items()])))
    if observation is not None:
        rows = rows.observe(observation, F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(f"r{k}") for k, bad in enumerate(failed.values())])
    return rows


#: Columns besides an entity's own that typed rows keep.
KEPT = ("client_id", "seq", "message_uuid")


def typed(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of judged(): rows that fail no rule, typed, and the others with their text and _failed."""
    rows = judged(df, entity)
    good = F.size("_failed") == 0
    return rows.where(good).drop("_text", "_failed"), rows.where(~good).select("_text.*", "_failed")


def failures(observation: Observation, entity: str) -> dict[str, int]:
    """By rule, how many rows failed it, once an action has run over judged(..., observation)."""
    got = observation.get
    return {"rows": got["rows"], **{name: got[f"r{k}"] for k, name in enumerate(rules(entity))}}


def checking_scan(spark: SparkSession, folder: str, entity: str, reduced: bool | QueryConfig = False) -> DataFrame:
    """What result checks read: all files of an entity with its moments as timestamps and its dates as dates, unreadable
    ones null, and numbers as they are typed; no row is rejected."""
    rows = judged(read_csv(spark, folder, entity, reduced), entity).drop("_text", "_failed")
    return rows.withColumn("created_at", C.iso_timestamp("created_at")) if "created_at" in rows.columns else rows


def split_messages(df: DataFrame, entity: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, dead) of JSON batch messages {client_id, message_uuid, data: [rows]}.

    rows are typed, with client_id, message_uuid and row_no, their place in the message. dead has client_id,
    message_uuid, row_no (null for whole messages), the text and a reason: empty text, not JSON, no rows (data is missing
    or no list), or the rules that a row fails.
    """
    row = ", ".join(f"{c}: string" for c in ENTITIES[entity])
    schema = f"client_id string, message_uuid string, data array<struct<{row}>>, _corrupt string"
    parsed = df.select(F.col(value).cast("string").alias("text")).withColumn("m", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text").when(F.col("m").isNull() | F.col("m._corrupt").isNotNull(), "not JSON").when(F.col("m.data").isNull(), "no rows")
    parsed = parsed.withColumn("reason", reason)
    whole = parsed.where("reason is not null").select("m.client_id", "m.message_uuid", F.lit(None).cast("int").alias("row_no"), "text", "reason")
    each = parsed.where("reason is null").select("m.client_id", "m.message_uuid", F.posexplode("m.data").alias("row_no", "r")).select(F.struct("client_id", "message_uuid", "row_no").alias("_from"), "r.*")
    rows = each.select(*[_typed(entity, c, t).alias(c) for c, t in ENTITIES[entity].items()], "_from", F.struct(*ENTITIES[entity]).alias("_text"))
    rows = rows.withColumn("_failed", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules(entity).items()])))
    bad = rows.where(F.size("_failed") > 0).select("_from.*", F.to_json("_text").alias("text"), F.array_join("_failed", "; ").alias("reason"))
    return rows.where(F.size("_failed") == 0).select("_from.*", *ENTITIES[entity]), whole.unionByName(bad)


def messages(df: DataFrame, entity: str, value: str = "value") -> DataFrame:
    """Rows of JSON batch messages as text, with client_id, message_uuid and row_no; text that is no such message is dropped."""
    row = ", ".join(f"{c}: string" for c in ENTITIES[entity])
    parsed = F.from_json(F.col(value), f"client_id string, message_uuid string, sequence_id string, data array<struct<{row}>>")
    read = df.select(parsed.alias("m")).where("m is not null and m.data is not null")
    return read.select("m.client_id", "m.message_uuid", F.posexplode("m.data").alias("row_no", "r")).select("client_id", "message_uuid", "row_no", "r.*")
