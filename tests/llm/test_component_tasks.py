import pytest

pytest.importorskip("numpy")

from tallyhouse.llm.components import components


def test_few_edges_are_written_by_few_tasks(spark):
    """Chains of ten: a shuffle of 40 partitions wrote as many files in every step."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = components(spark.range(2000).where("id % 10 > 0").selectExpr("id a", "id - 1 b"))
        got = sorted(map(tuple, found.collect()))
        files = found.inputFiles()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(k, k - k % 10) for k in range(2000)]
    assert len(files) <= spark.sparkContext.defaultParallelism
