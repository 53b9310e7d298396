"""No task meets a whole file's partial totals, and no turn all changed files."""

from pyspark.sql import functions as F

from tallyhouse.operators import rollup as U


def test_partials_of_a_large_file_are_dealt(spark, tmp_path, monkeypatch):
    rows = spark.range(60_000).selectExpr("id k", "id % 7 v")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    turns = []
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        read = lambda paths: (turns.append(paths), spark.read.parquet(*paths))[1]
        assert U.refresh(spark, f"{tmp_path}/in", f"{tmp_path}/kept", lambda df: df.groupBy("file", "k").agg(F.sum("v").alias("v")), read=read, size=1) == 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(turns) > 1 and sorted(p for t in turns for p in t) == sorted({p for t in turns for p in t})
    files = [f for f in (tmp_path / "kept" / "partials").rglob("*.parquet")]
    assert len({f.parent for f in files}) == 3 and len(files) > 6
    monkeypatch.setattr(U, "PART", 1000)
    got = U.totals(spark, f"{tmp_path}/kept", ["k"], ["v"])
    want = rows.groupBy("k").agg(F.sum("v").alias("v"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
