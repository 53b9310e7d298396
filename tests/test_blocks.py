"""Rows that wait in state do so in blocks, whatever their types, and come out as they went in."""

import random

from pyspark.sql import functions as F

from tallyhouse.streaming import blocks as B, jobs as J, keyed as K

MESSAGES = "client_id string, kind string, message_uuid string, amount double, seq long"
ODD = ["cast(1.5 as decimal(12,3)) d", "if(id % 3 = 0, null, timestamp'2024-03-10 02:30:00' + make_dt_interval(0, 0, 0, id)) t", "if(id % 4 = 0, null, named_struct('a', cast(id as int), 'b', array(id, null))) s", "if(id % 5 = 0, null, cast(id as int)) i", "map('k', id) m"]


def state(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state")


def same(a, b):
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)))).collect())
    return dict(a.dtypes) == dict(b.dtypes) and text(a) == text(b)


def test_blocks_are_small_and_whole(spark):
    import pyarrow as pa

    table = pa.table({"n": range(3000), "x": ["é" * 1000] * 3000})
    blocks = list(B.blocks_of(table))
    assert max(map(len, blocks)) < 2 * B.SIZE and pa.concat_tables(map(B.table_of, blocks)).equals(table)
    df = spark.range(2000).selectExpr("if(id % 7 = 0, null, cast(id % 3 as string)) client_id", "id", *ODD)
    assert same(B.unpacked(B.packed(df, ["client_id"]), df.schema), df)


def test_gate_holds_blocks(spark, tmp_path):
    df = spark.range(6000).selectExpr("if(id % 2 = 0, 'a', null) client_id", "id", *ODD)
    ends = "client_id string, input string"
    df.write.parquet(f"{tmp_path}/rows")
    spark.createDataFrame([("a", "x")], ends).write.parquet(f"{tmp_path}/ends")
    run = lambda: J.run_available(K.gated(J.file_stream(spark, f"{tmp_path}/rows", df.schema), J.file_stream(spark, f"{tmp_path}/ends", ends), ["x", "y"], parts=3), f"{tmp_path}/run")
    run()
    assert 0 < state(spark, f"{tmp_path}/run", "waiting").count() < 100
    spark.createDataFrame([("a", "y"), (None, "x"), (None, "y")], ends).write.mode("append").parquet(f"{tmp_path}/ends")
    run()
    assert same(spark.read.parquet(f"{tmp_path}/run/out").drop("batch", "number"), df)


def test_barrier_holds_blocks_over_a_reset(spark, tmp_path):
    rng = random.Random(4)
    rows = [("a", "data", rng.choice([None, "", f"m{rng.randrange(900)}"]), rng.choice([None, float(k % 11)]), k) for k in range(5000)]
    put = lambda rows: spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: J.run_barrier(J.file_stream(spark, f"{tmp_path}/in", MESSAGES), f"{tmp_path}/run", 2, parts=2)
    put(rng.sample(rows, len(rows)))
    run()
    assert state(spark, f"{tmp_path}/run", "messages").count() + state(spark, f"{tmp_path}/run", "blocks").count() < 100
    put([("a", "CLIENT_RESET", None, None, 1000), ("a", "EOF", "x", None, 2000), ("a", "EOF", "y", None, 4000)])
    run()
    first, nameless = {}, []
    for _, _, name, amount, seq in rows[1001:4001]:
        first.setdefault(name, amount) if name else nameless.append(amount)
    amounts = [*first.values(), *nameless]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/run/out").select("amount", "n_rows").collect()] == [(sum(a or 0 for a in amounts), len(amounts))]
    # What came after the last marker waits on, and is sent after another reset.
    put([("a", "CLIENT_RESET", None, None, 4990), ("a", "EOF", "x", None, 6000), ("a", "EOF", "y", None, 6000)])
    run()
    left = {name or seq: amount for _, _, name, amount, seq in reversed(rows[4991:])}
    assert sorted(r["n_rows"] for r in spark.read.parquet(f"{tmp_path}/run/out").collect()) == sorted([len(amounts), len(left)])


def test_named_facts_wait_in_blocks(spark, tmp_path):
    df = spark.range(6000).selectExpr("'a' client_id", "cast(if(id % 9 = 0, null, id % 5) as int) k", "id", *ODD)
    name, end = "client_id string, key string, name string, seq long", "client_id string"
    df.write.parquet(f"{tmp_path}/facts")
    spark.createDataFrame([("a", str(k), f"n{k}", 1) for k in range(4)], name).write.parquet(f"{tmp_path}/names")
    spark.createDataFrame([], end).write.parquet(f"{tmp_path}/ends")
    read = lambda f, schema: J.file_stream(spark, f"{tmp_path}/{f}", schema)
    run = lambda: J.run_available(K.named(read("facts", df.schema), read("names", name), read("ends", end), "k", "title", "none", copies=2, parts=3), f"{tmp_path}/run")
    run()
    assert 0 < state(spark, f"{tmp_path}/run", "waiting").count() < 100
    spark.createDataFrame([("a",)], end).write.mode("append").parquet(f"{tmp_path}/ends")
    run()
    want = df.withColumn("title", F.when(F.col("k") < 4, F.concat(F.lit("n"), F.col("k").cast("string"))).otherwise("none"))
    assert same(spark.read.parquet(f"{tmp_path}/run/out").drop("batch", "number"), want)
