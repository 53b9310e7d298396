"""Rules that the given tables don't show, on rows written by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.config import QueryConfig
from tallyhouse.functions import columns as C
from tallyhouse.operators import aggregate as A, filters as L, quality as V, ranking as R, results as S
from tallyhouse.operators.dimensions import Dimension, lookup
from tallyhouse.plans import questions as Q
from tallyhouse.sources import ingest


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_numbers(spark):
    assert column(spark, ["1.5", " 80 ", "75d", "", None, "abc", "inf"], C.safe_double) == [1.5, 80.0, 0.0, 0.0, 0.0, 0.0, float("inf")]
    assert column(spark, ["3.7", "12.0", "-3", "", "x"], C.safe_long) == [3, 12, -3, 0, 0]
    assert column(spark, ["3", "3.0", "-1"], lambda c: C.safe_long(c, 0)) == [3, 0, 0]


def test_amount_bounds(spark):
    got = column(spark, ["74.99", "75", "", "abc", "nan", "75d", " 80 "], lambda c: L.amount_at_least(c, 75.0))
    assert got == [False, True, False, False, False, False, True]


def test_time_bounds(spark):
    texts = ["05:59:59", "06:00:00", "23:00:00", "23:00:01", "00:00:00"]
    assert column(spark, [f"2024-01-05 {t}" for t in texts], lambda c: L.time_between(C.strict_timestamp(c), "06:00:00", "23:00:00")) == [False, True, True, False, False]


def test_moments(spark):
    texts = ["2024-01-05 07:00:00", "2024-1-5 7:00:00", "2024-01-15T10:00:00", "2024", "", None, "2024-02-30 00:00:00"]
    there = lambda f: [x is not None for x in column(spark, texts, f)]
    assert there(C.strict_timestamp) == [True] + [False] * 6
    assert there(C.lenient_timestamp) == [True, True] + [False] * 5
    assert there(C.iso_timestamp) == [True, False, True, False, False, False, False]
    assert column(spark, ["2024-01-15T10:00:00", "2024-1", "garbage text", "2024-1-5 7:00:00", "20240115"], C.year_month_text) == ["2024-01", None, "garbage", "2024-01", "2024011"]


def test_halves_and_months(spark):
    assert column(spark, [datetime(2024, 6, 30), datetime(2024, 7, 1)], C.year_half, "timestamp_ntz") == ["2024-H1", "2024-H2"]
    assert [r["text"] if r else None for r in column(spark, ["2024-H1", "2024-1", "2024h2", "x"], C.normalized_half)] == ["2024-H1", "2024-H1", "2024-H2", "x"]
    assert [r["text"] for r in column(spark, ["2024-1", "2024-12", "2024-13"], C.normalized_month)] == ["2024-01", "2024-12", None]


def test_year_set(spark):
    ts = [datetime(y, 5, 1) for y in (2022, 2023, 2024, 2025)]
    assert column(spark, ts, lambda c: L.year_in(c, (2022, 2025)), "timestamp_ntz") == [True, False, False, True]
    assert column(spark, ts, lambda c: L.year_in(c, (2024, 2025)), "timestamp_ntz") == [False, False, True, True]


@pytest.mark.parametrize("compat,want", [(False, [1, 2, 3]), (True, [1, 2])])
def test_anonymous(spark, compat, want):
    rows = [(7, u, datetime(2024, 1, 1)) for u, n in ((0, 10), (1, 4), (2, 3), (3, 2), (4, 1)) for _ in range(n)]
    t = spark.createDataFrame(rows, "store_id int, user_id long, created_at timestamp_ntz")
    users = Dimension(spark.createDataFrame([(1, "1990-01-01")], "id long, b string"), "id", "b", "Unknown Birthday")
    stores = Dimension(spark.createDataFrame([(1, "A")], "id int, n string"), "id", "n", "Unknown Store")
    got = Q.top_clients(t, users, stores, QueryConfig(compat_anonymous=compat)).orderBy("user_id").collect()
    assert [r["user_id"] for r in got] == want
    assert got[0]["birthdate"] == "1990-01-01" and got[1]["birthdate"] == "Unknown Birthday" and got[0]["store_name"] == "Unknown Store"


def test_ties(spark):
    df = spark.createDataFrame([(1, u, c) for u, c in enumerate((5, 5, 4, 4, 3))], "s int, u int, c int")
    n = lambda ties: R.top_n(df, ["s"], "c", 3, ties, ["u"]).count()
    assert (n("row_number"), n("rank"), n("dense_rank")) == (3, 4, 5)


def test_dimension(spark):
    d = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, " ", 1), (None, "C", 1)], "id int, name string, seq int")
    rows = spark.createDataFrame([(1,), (2,), (99,), (None,)], "k int")
    got = {r["k"]: r["n"] for r in lookup(rows, Dimension(d, "id", "name", "none", ("seq",)), "k", "n").collect()}
    assert got == {1: "B", 2: "none", 99: "none", None: "none"}


def test_first_of_each(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), (None, 3, 3), (None, 3, 4)], "transaction_id string, x int, seq int")
    assert sorted(r["x"] for r in Q.first_of_each(df).collect()) == [2, 3, 3]


def test_ingest(spark, tmp_path):
    folder = tmp_path / "transactions"
    folder.mkdir()
    head = "transaction_id, store_id,payment_method_id,voucher_id,user_id,original_amount,discount_applied,final_amount,created_at\n"
    (folder / "202401.csv").write_text(head + "t1, 4 ,1,,12.0,80,,74.9999996,2024-01-01 07:00:00\nt2,x,1,,,1,1,1,2024-01-01 07:00:00\n")
    (folder / "202402.csv").write_text(head + "t3,5,1,0.0,,1,1,1,2024-02-01 07:00:00\n")
    rows, rejects = ingest.typed(ingest.read_csv(spark, str(tmp_path), "transactions", client_id="c"), "transactions")
    got = {r["transaction_id"]: r for r in rows.collect()}
    assert got["t1"]["store_id"] == 4 and got["t1"]["user_id"] == 12 and got["t1"]["discount_applied"] == 0.0 and got["t1"]["final_amount"] == 75.0
    assert got["t3"]["user_id"] == 0 and got["t3"]["voucher_id"] is None and [r["transaction_id"] for r in rejects.collect()] == ["t2"]
    assert ingest.read_csv(spark, str(tmp_path), "transactions", reduced=True).count() == 2
    assert ingest.read_csv(spark, str(tmp_path), "stores").count() == 0


def test_messages(spark):
    df = spark.createDataFrame([('{"client_id":"c","message_uuid":"m","data":[{"store_id":"1","store_name":"A"},{"store_id":"2"}]}',), ("no json",)], "value string")
    got = ingest.messages(df, "stores").orderBy("row_no").collect()
    assert [(r["store_id"], r["store_name"]) for r in got] == [("1", "A"), ("2", None)]


def test_caps_and_lines(spark):
    df = spark.createDataFrame([(i, "Same", f"19{i}0-01-01") for i in range(6)], "store_id int, store_name string, birthdate string")
    assert S.lines_clients(df).count() == 3
    none = spark.createDataFrame([], "year_month_created_at string, item_name string, sellings_qty long")
    assert S.lines_items(none, "sellings_qty").count() == 1
    assert column(spark, [0.125, 2.675, None], C.money, "double") == ["0.13", "2.68", "0.00"]


def test_mismatches(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 1.0)], "k string, v double")
    e = spark.createDataFrame([("x", 1.005), ("y", 2.5), ("w", 1.0)], "k string, v double")
    assert {r["k"]: r["reason"] for r in V.mismatches(a, e, ["k"], "v", 0.01).collect()} == {"y": "value", "z": "unexpected", "w": "missing"}
    assert V.aligned(a, ["v", "q"]).columns == ["v", "q"]


def test_partials_add_up(spark):
    df = spark.createDataFrame([(i % 3, i, 0.1 * i) for i in range(50)], "k int, part int, v double")
    parts = df.groupBy("k", (F.col("part") % 7).alias("p")).agg(A.money_sum("v").alias("v"))
    assert A.merge_partials(parts, ["k"], ["v"]).orderBy("k").collect() == df.groupBy("k").agg(A.money_sum("v").alias("v")).orderBy("k").collect()


def test_half_of_text(spark):
    assert column(spark, ["2024-7-5 7:00:00", "2024-01-15T10:00:00", "garbage", None], C.year_half_text) == ["2024-H2", "2024-H1", None, None]


def test_thresholds_from_the_environment():
    got = QueryConfig.from_environment({"MIN_YEAR": "2022", "MIN_AMOUNT": "15.5"})
    assert got.years == (2022, 2025) and got.min_amount == 15.5 and got.start == "06:00:00"


def test_envelopes_hold_a_bounded_number_of_rows(spark):
    """Equal rows too are dealt over parts; every row is in one, and a client without an id has its own."""
    rows = spark.createDataFrame([("a", k // 2) for k in range(25)] + [(None, 7)] * 8, "client_id string, k int")
    got = [(r["part"], json.loads(r["value"])) for r in S.envelopes(rows, S.TPV, 3).collect()]
    assert all(len(e["results"]) <= 3 for _, e in got)
    assert sorted(p for p, e in got if e.get("client_id") == "a") == list(range(9))
    assert sorted((e.get("client_id") or "", r["k"]) for _, e in got for r in e["results"]) == sorted((c or "", k) for c, k in map(tuple, rows.collect()))


def test_mismatches_pair_the_nth_values(spark):
    """Null keys are keys, null values equal null alone, and repeats count."""
    make = lambda rows: spark.createDataFrame(rows, "k string, v double")
    actual = make([("same", 1.0), ("same", 5.0), ("apart", 1.0), ("apart", 5.0), ("more", 1.0), ("more", 1.0), ("extra", 1.0), (None, 1.0), ("null", None), ("one", None)])
    expected = make([("same", 5.0), ("same", 1.2), ("apart", 5.0), ("apart", 2.0), ("more", 1.0), ("gone", 1.0), (None, 1.1), ("null", None), ("one", 1.0)])
    got = {tuple(r) for r in V.mismatches(actual, expected, ["k"], "v", atol=0.5).collect()}
    assert got == {("apart", "value"), ("more", "count"), ("extra", "unexpected"), ("gone", "missing"), ("one", "value")}
    assert V.mismatches(make([]), make([]), ["k"], "v").count() == 0
    assert V.full_report({"Q1": spark.createDataFrame([], "transaction_id long, final_amount double")}, {"Q1": spark.createDataFrame([(4, 1.0)], "transaction_id long, final_amount double")}).collect() == [("Q1", False, 1, -1, "4")]
