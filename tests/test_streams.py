"""Streams over many files that are not in the order of time, of which a batch takes four."""

import random
from datetime import datetime, timedelta

import pytest

from tallyhouse import catalog
from tallyhouse.streaming import jobs, keyed

FILES, ROWS = 12, 1200


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """1,200 events of 200 days, dealt at random over 12 files."""
    place = tmp_path_factory.mktemp("many")
    ids = list(range(ROWS))
    random.Random(4).shuffle(ids)
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=4 * i), i % 90, "click", float(i % 7) + 0.5) for i in ids]
    for k in range(FILES):
        spark.createDataFrame(rows[k::FILES], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{place}/events.parquet")
    return str(place)


@pytest.mark.parametrize("name,least", [("stream_barrier", 0), ("stream_reset", 301)])
def test_barrier_waits_for_all_files(spark, many_files, name, least):
    got = sorted(map(tuple, catalog.queries()[name](spark, many_files).collect()))
    # Messages without an id count each time, also those that were sent again with a million.
    want = {c: [x for i in range(least, ROWS) if i % 5 == c for x in [float(i % 7), *[1e6] * (i % 25 == 0)]] for c in range(5)}
    assert got == [(str(c), sum(v), len(v)) for c, v in want.items()]


def test_dedup_keeps_late_rows(spark, many_files):
    assert sorted(r["event_id"] for r in catalog.queries()["stream_dedup"](spark, many_files).collect()) == list(range(ROWS))


def test_delivery_over_a_restart(spark, tmp_path):
    """A batch that was put down but not committed runs again; files that came meanwhile follow; no row is lost or twice."""
    schema = "client_id string, transaction_id long, final_amount double"
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    write([("a", 1, 1.0), ("b", 1, 2.0), ("a", 1, 1.0)])
    run = lambda: jobs.deliver(jobs.file_stream(spark, source, schema, files=1), folder, ["transaction_id"])
    run()
    commits = tmp_path / "run" / "state" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (commits / name).exists():
            (commits / name).rename(tmp_path / f"lost{name}")
    write([("a", 1, 1.0), ("a", 2, 3.0)])
    run()
    got = sorted(tuple(r) for r in jobs.delivered(spark, folder).select("client_id", "transaction_id", "final_amount").collect())
    assert got == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)]
    assert [r["transaction_id"] for r in jobs.delivered(spark, folder, "b").collect()] == [1]


def test_facts_in_many_files_take_one_batch_a_run(spark, many_files, monkeypatch):
    """Of 12 files that each of the three writings of facts makes, a batch took four."""
    batches, run = [], jobs.run_available
    monkeypatch.setattr(jobs, "run_available", lambda *a, **k: batches.append(len(run(*a, **k))))
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.mode("ignore").parquet(f"{many_files}/nation.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = catalog.queries()["stream_named"](spark, many_files).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert batches == [1, 1, 1, 1]
    assert sorted(r["transaction_id"] for r in got) == list(range(ROWS))
    assert {r["store_name"] for r in got if r["store_id"] == 7} == {"old NATION_7"}


def test_keyed_queries_take_few_tasks(spark):
    """Each task opens a store and a worker in every batch, so 200 of them cost more than the rows."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        for of_session, inside in (("200", "32"), ("3", "3")):
            spark.conf.set(name, of_session)
            with keyed.settings(spark):
                assert spark.conf.get(name) == inside
            assert spark.conf.get(name) == of_session
    finally:
        spark.conf.set(name, before)
