"""State that is kept between batches, deliveries and runs: each against a plain version of what it should hold."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.config import QueryConfig
from tallyhouse.operators import aggregate as A, results as S, rollup as U
from tallyhouse.operators.kept import KeptDimension
from tallyhouse.sinks.result_files import client_folder, read_lines, write_lines
from tallyhouse.sources import ingest as I
from tallyhouse.streaming import jobs as J, keyed as K

MESSAGES = "client_id string, kind string, message_uuid string, amount double, seq long"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def state(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state")


def barrier(spark, tmp_path, files=None):
    return J.run_barrier(J.file_stream(spark, str(tmp_path / "in"), MESSAGES, files=files or 1), str(tmp_path / "run"), 2, parts=3)


def sent(spark, tmp_path):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "run" / "out")).select("client_id", "amount", "n_rows").collect())


def test_barrier_reads_each_message_once_and_frees_the_client(spark, tmp_path):
    some = lambda lo: [("a", "data", f"m{k % 30}", 1.0, lo + k) for k in range(40)] + [("b", "data", None, 1.0, lo + k) for k in range(10)] + [("b", "data", "", 2.0, lo + k) for k in range(10)]
    seen = []
    for k in range(4):
        put(spark, some(100 * k), MESSAGES, tmp_path / "in")
        seen += barrier(spark, tmp_path)
    assert [b["rows"] for b in seen] == [60] * 4 and sent(spark, tmp_path) == [] and state(spark, tmp_path / "run", "messages").count() == 240
    put(spark, [("a", "EOF", "e1", None, 900), ("a", "EOF", "e1", None, 901)], MESSAGES, tmp_path / "in")
    assert [b["rows"] for b in barrier(spark, tmp_path)] == [2] and sent(spark, tmp_path) == []
    put(spark, [("a", "EOF", "e2", None, 902)], MESSAGES, tmp_path / "in")
    assert [b["rows"] for b in barrier(spark, tmp_path)] == [1]
    assert sent(spark, tmp_path) == [("a", 30.0, 30)]
    assert {r["key"]["client_id"] for r in state(spark, tmp_path / "run", "messages").collect()} == {"b"} and state(spark, tmp_path / "run", "marks").count() == 0
    put(spark, [("b", "EOF", "e1", None, 900), ("b", "EOF", "e2", None, 900), ("c", "EOF", "e1", None, 1), ("c", "EOF", "e2", None, 2)], MESSAGES, tmp_path / "in")
    barrier(spark, tmp_path)
    assert sent(spark, tmp_path) == [("a", 30.0, 30), ("b", 120.0, 80), ("c", 0.0, 0)] and state(spark, tmp_path / "run", "messages").count() == 0


def test_barrier_after_it_was_sent(spark, tmp_path):
    """Repeated markers and late data send nothing again; a reset begins anew, with what came after it."""
    put(spark, [("a", "data", "m", 5.0, 1), ("a", "EOF", "x", None, 2), ("a", "EOF", "y", None, 3)], MESSAGES, tmp_path / "in")
    barrier(spark, tmp_path)
    put(spark, [("a", "data", "late", 7.0, 1), ("a", "EOF", "x", None, 2), ("a", "EOF", "y", None, 3), ("a", "EOF", "x", None, 8), ("a", "EOF", "y", None, 9), ("a", "data", "next", 3.0, 12)], MESSAGES, tmp_path / "in")
    barrier(spark, tmp_path)
    assert sent(spark, tmp_path) == [("a", 5.0, 1)]
    put(spark, [("a", "CLIENT_RESET", None, None, 10), ("a", "EOF", "x", None, 20), ("a", "EOF", "y", None, 21)], MESSAGES, tmp_path / "in")
    barrier(spark, tmp_path)
    assert sent(spark, tmp_path) == [("a", 3.0, 1), ("a", 5.0, 1)]
    # Repeats of what was sent leave no state, and a seq of 0 is one like any other.
    put(spark, [("a", "EOF", "x", None, 20), ("a", "data", "next", 3.0, 12), ("z", "data", "m", 1.0, -1), ("z", "EOF", "x", None, 0), ("z", "EOF", "y", None, 0)], MESSAGES, tmp_path / "in")
    barrier(spark, tmp_path)
    assert sent(spark, tmp_path) == [("a", 3.0, 1), ("a", 5.0, 1), ("z", 1.0, 1)]
    assert state(spark, tmp_path / "run", "marks").count() == 0 and state(spark, tmp_path / "run", "messages").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_barrier_in_any_order_of_files(spark, tmp_path, seed):
    """Data in any order over files, one batch repeated after it was put down but not committed; markers last."""
    rng = random.Random(seed)
    rows, want = [], {}
    for c in "abcde":
        reset, first = rng.randrange(50), {}
        for k, seq in enumerate(rng.sample(range(100), 60)):
            name, seq, amount = rng.choice([None, "", *(f"m{j}" for j in range(25))]), 10 * seq + 1, float(rng.randrange(100))
            rows.append((c, "data", name, amount, seq))
            if seq > reset * 10 and (not name or name not in first or seq < first[name][0]):
                first[name or (k,)] = (seq, amount)
        rows.append((c, "CLIENT_RESET", None, None, reset * 10))
        want[c] = first
    rng.shuffle(rows)
    for k in range(4):
        put(spark, rows[k::4], MESSAGES, tmp_path / "in")
    barrier(spark, tmp_path)
    marks = [(c, "EOF", e, None, 5000 + n) for c in "abcde" for n, e in enumerate(("x", "y"))]
    put(spark, marks, MESSAGES, tmp_path / "in")
    barrier(spark, tmp_path)
    commits = tmp_path / "run" / "state" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (commits / name).exists():
            (commits / name).rename(tmp_path / f"lost{name}")
    barrier(spark, tmp_path)
    assert sent(spark, tmp_path) == [(c, sum(a for _, a in want[c].values()), len(want[c])) for c in "abcde"]


def test_one_client_is_many_parts(spark):
    rows = spark.range(3000).selectExpr("'hot' client_id", "'data' kind", "if(id % 3 = 0, null, concat('m', id)) message_uuid", "1.0D amount", "id seq")
    dealt = K.dealt(rows, "kind = 'data'", ["message_uuid", "seq"], 16).groupBy("part").count().collect()
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 300
    assert K.dealt(rows.limit(1).withColumn("kind", F.lit("EOF")), "kind = 'data'", ["message_uuid"], 16).count() == 16


def test_session_settings_are_put_back(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in K.SETTINGS}
    put(spark, [(1, "x")], "k long, v string", tmp_path / "in")
    J.run_available(J.without_repeats(J.file_stream(spark, str(tmp_path / "in"), "k long, v string"), ["k"]), str(tmp_path / "run"))
    assert {k: spark.conf.get(k, None) for k in K.SETTINGS} == before


def test_rows_without_a_key_are_no_repeats(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 1, 1.0), ("a", None, 2.0), ("a", None, 2.0), (None, 4, 3.0), (None, 4, 3.0), ("", 5, 4.0)]
    put(spark, rows, "client_id string, transaction_id long, amount double", tmp_path / "in")
    put(spark, rows, "client_id string, transaction_id long, amount double", tmp_path / "in")
    J.deliver(J.file_stream(spark, str(tmp_path / "in"), "client_id string, transaction_id long, amount double", files=1), str(tmp_path / "run"), ["transaction_id"])
    got = Counter((r["transaction_id"], r["amount"]) for r in J.delivered(spark, str(tmp_path / "run")).collect())
    assert got == {(1, 1.0): 1, (None, 2.0): 4, (4, 3.0): 4, (5, 4.0): 2}


def test_facts_wait_for_their_dimension(spark, tmp_path):
    fact, name, end = "client_id string, k string, n long", "client_id string, key string, name string, seq long", "client_id string"
    for f, schema in (("facts", fact), ("names", name), ("ends", end)):
        put(spark, [], schema, tmp_path / f)
    read = lambda f, schema: J.file_stream(spark, str(tmp_path / f), schema)
    run = lambda: J.run_available(K.named(read("facts", fact), read("names", name), read("ends", end), "k", "title", "none", copies=3, parts=5), str(tmp_path / "run"))
    got = lambda: sorted((r["client_id"], r["k"] or "", r["n"], r["title"]) for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect())
    hot = [("a", "x", k) for k in range(20)]
    put(spark, [*hot, ("a", "z", 100), ("a", None, 101), ("b", "x", 102), ("b", "x", 102)], fact, tmp_path / "facts")
    put(spark, [("a", "x", "old", 1), ("a", "x", "new", 3), ("a", "x", "mid", 2), ("a", "x", "unnumbered", None), ("a", "q", " ", 9), ("b", "x", "of b", 1)], name, tmp_path / "names")
    run()
    assert got() == []
    put(spark, [("a", "x", 200), ("a", "q", 201)], fact, tmp_path / "facts")
    put(spark, [("a",)], end, tmp_path / "ends")
    run()
    first = sorted([("a", "x", k, "new") for k in range(20)] + [("a", "z", 100, "none"), ("a", "", 101, "none"), ("a", "x", 200, "new"), ("a", "q", 201, "none")])
    assert got() == first
    assert {r["key"]["client_id"] for r in state(spark, tmp_path / "run", "waiting").collect()} == {"b"}
    put(spark, [("a", "x", 300), ("a", "z", 301)], fact, tmp_path / "facts")
    put(spark, [("a", "z", "at last", 5), ("a", "x", "too old", 1)], name, tmp_path / "names")
    put(spark, [("b",), ("b",)], end, tmp_path / "ends")
    run()
    assert got() == sorted(first + [("a", "x", 300, "new"), ("a", "z", 301, "at last"), ("b", "x", 102, "of b"), ("b", "x", 102, "of b")])


def test_gate_opens_once_all_inputs_ended(spark, tmp_path):
    row, end = "client_id string, n long, note string", "client_id string, input string"
    put(spark, [], end, tmp_path / "ends")
    run = lambda: J.run_available(K.gated(J.file_stream(spark, str(tmp_path / "rows"), row), J.file_stream(spark, str(tmp_path / "ends"), end), ["x", "y"], parts=3), str(tmp_path / "run"))
    got = lambda: sorted((r["client_id"] or "", r["n"]) for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect())
    put(spark, [("a", 1, None), ("b", 2, "t"), (None, 3, None)], row, tmp_path / "rows")
    put(spark, [("a", "x"), ("a", "other"), ("b", "x"), ("b", "x"), (None, "x")], end, tmp_path / "ends")
    run()
    assert got() == []
    put(spark, [("a", "y"), (None, "y"), ("a", None)], end, tmp_path / "ends")
    put(spark, [("a", 4, "t"), ("b", 5, None)], row, tmp_path / "rows")
    run()
    assert got() == [("", 3), ("a", 1), ("a", 4)] and {r["key"]["client_id"] for r in state(spark, tmp_path / "run", "waiting").collect()} == {"b"}


def test_ranking_is_fed_by_changes(spark, tmp_path, monkeypatch):
    """In any order of files the ranking is that of all counts; a batch handles the counts that it changed."""
    rng = random.Random(6)
    events = [(s, min(int(rng.expovariate(0.15)), 40) + 1) for s in range(4) for _ in range(150)]
    rng.shuffle(events)
    schema = "store_id int, user_id long"
    counts = lambda: A.purchase_counts(J.file_stream(spark, str(tmp_path / "in"), schema, files=1))
    handled, real = [], J.kept_ranking
    put(spark, events[:400], schema, tmp_path / "in")
    J.run_ranking(counts(), str(tmp_path / "run"), ["store_id"], "user_id", "purchases_qty", 3)
    monkeypatch.setattr(J, "kept_ranking", lambda *a: (handled.append(real(*a).count()), real(*a))[1])
    total, ranking, changes = Counter(events[:400]), {}, []
    for k in range(400, 600, 50):
        put(spark, events[k : k + 50], schema, tmp_path / "in")
        J.run_ranking(counts(), str(tmp_path / "run"), ["store_id"], "user_id", "purchases_qty", 3)
        total.update(events[k : k + 50])
    want = sorted((s, u, n, r) for s in range(4) for r, (n, u) in enumerate(sorted(((n, u) for (t, u), n in total.items() if t == s), key=lambda x: (-x[0], x[1]))[:3], 1))
    assert sorted(tuple(r) for r in real(spark, str(tmp_path / "run")).collect()) == want
    assert handled and max(handled) <= 12
    # The changes, batch by batch, give the ranking too.
    for r in sorted(spark.read.parquet(str(tmp_path / "run" / "out")).collect(), key=lambda r: (r["number"], r["rank"] is not None)):
        ranking[r["store_id"], r["user_id"]] = (r["purchases_qty"], r["rank"])
        changes.append(r)
    assert sorted((*k, *v) for k, v in ranking.items() if v[1] is not None) == want and len(changes) < 5 * 12


def test_rollup_reads_changed_files_alone(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "kept")
    write = lambda name, rows: spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("overwrite").parquet(str(source / name))
    read = []
    partial = lambda df: df.where("v >= 0").groupBy("file", "k").agg(F.sum("v").alias("v"))
    refresh = lambda: U.refresh(spark, str(source), folder, partial, read=lambda p: (read.extend(p), spark.read.parquet(*p))[1])
    totals = lambda: {r["k"]: r["v"] for r in U.totals(spark, folder, ["k"], ["v"]).collect()}
    assert refresh() == 0
    with pytest.raises(ValueError):
        totals()
    write("one", [("a", 1), ("b", 2)]), write("two", [("a", 10)]), write("three", [("c", 100), ("a", 1000)])
    assert refresh() == 3 and totals() == {"a": 1011, "b": 2, "c": 100}
    read.clear()
    assert refresh() == 0 and read == [] and totals() == {"a": 1011, "b": 2, "c": 100}
    write("two", [("a", 20), ("d", 5)])
    assert refresh() == 1 and len(read) == 1 and "/two/" in read[0] and totals() == {"a": 1021, "b": 2, "c": 100, "d": 5}
    write("two", [("a", -1)])  # nothing of it counts any more
    assert refresh() == 1 and totals() == {"a": 1001, "b": 2, "c": 100}
    for f in (source / "three").iterdir():
        f.rename(tmp_path / f.name)
    assert refresh() == 0 and totals() == {"a": 1, "b": 2}
    # A run that is lost after its partials, before its manifest, is made good by the next.
    write("one", [("a", 7)])
    _, known = U.manifest(spark, folder)
    known = spark.createDataFrame(known.collect(), U.MANIFEST)
    refresh()
    known.write.mode("overwrite").parquet(f"{folder}/manifest/number=99")
    assert refresh() == 1 and totals() == {"a": 7}


def exchanges(plan: str, table: str) -> int:
    """Exchanges above the scan of a table, up to the join."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "Scan parquet" in line and table in line)
    depth, n = len(lines[at]) - len(lines[at].lstrip(" :+-")), 0
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            depth = d
            if "Join" in line:
                return n
            n += "Exchange" in line
    raise AssertionError("no join above the table")


def test_kept_dimension(spark, tmp_path):
    name = f"dim_{tmp_path.name.replace('-', '_')}"[:40].lower()
    kept = KeptDimension(spark, name, str(tmp_path), buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "id int, title string, at int")
    facts = spark.createDataFrame([(k % 5, k) for k in range(20)], "id int, n long")
    named = lambda v=None: {r["id"]: r["title"] for r in kept.lookup(facts, "id", "title", "?", v).collect()}
    assert kept.deliver(rows((0, "zero", 1), (1, "one", 1), (1, "uno", 2), (2, " ", 9), (None, "x", 1)), "id", "title", "at") == 1
    assert named() == {0: "zero", 1: "uno", 2: "?", 3: "?", 4: "?"}
    assert kept.deliver(rows((1, "stale", 1), (0, "null", 3), (3, "three", None)), "id", "title", "at") == 2
    assert named() == {0: "null", 1: "uno", 2: "?", 3: "three", 4: "?"} and named(1)[0] == "zero"
    assert kept.deliver(spark.createDataFrame([], "id int, title string, at int"), "id", "title", "at") == 3
    assert named() == named(2) and kept.lookup(facts, "id", "title", "?").count() == 20
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.lookup(facts, "id", "title", "?")._jdf.queryExecution().executedPlan().toString()
        assert exchanges(plan, f"{name}_v3") == 0 and "Exchange" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    kept.drop_before(3)
    assert kept.versions() == [3] and named()[3] == "three" and not (tmp_path / f"{name}_v1").exists()


def test_result_files_in_order(spark, tmp_path):
    """One client's file is dealt over tasks and comes back in order; other clients' are whole files; a second write replaces all."""
    rows = [("hot", "big.txt", k, f"line {k:05d}") for k in range(5000)] + [(c, "small.txt", k, f"{c} {k}") for c in (None, "", "a/b", "ü") for k in (2, 1, 3)]
    df = spark.createDataFrame(rows, "client_id string, file string, o int, line string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_lines(df, ["o"], str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = defaultdict(list)
    for r in sorted(read_lines(spark, str(tmp_path / "out")).collect(), key=lambda r: r["n"]):
        got[r["client_id"], r["file"]].append((r["n"], r["line"]))
    want = defaultdict(list)
    for c, f, _, line in sorted(rows, key=lambda r: r[2]):
        want[c, f].append((len(want[c, f]) + 1, line))
    assert got == want
    parts = sorted(p.name for p in (tmp_path / "out" / client_folder("hot")).iterdir())
    assert len(parts) > 1 and parts[0] == "big.txt.00001"
    assert "".join((tmp_path / "out" / client_folder("hot") / p).read_text() for p in parts) == "".join(f"line {k:05d}\n" for k in range(5000))
    assert (tmp_path / "out" / client_folder("a/b") / "small.txt").read_text() == "a/b 1\na/b 2\na/b 3\n"
    write_lines(df.where("client_id = 'ü'"), ["o"], str(tmp_path / "out"))
    assert read_lines(spark, str(tmp_path / "out")).count() == 3 and not (tmp_path / "out" / client_folder("hot") / parts[0]).exists()
    assert not list((tmp_path / "out" / "_pending").iterdir())
    write_lines(df.where("false"), ["o"], str(tmp_path / "out"))
    assert read_lines(spark, str(tmp_path / "out")).count() == 0


def test_sequences_of_result_lines(spark, tmp_path):
    """Orders of the four kinds of result, as numbers where ids are numbers, with ties."""
    items = spark.createDataFrame([("c", "2024-10", "10", "ten", 5), ("c", "2024-9", "9", "nine", 5), ("c", "2024-10", "9", "nine", 5), ("c", "2024-10", "2", "two", 7)], "client_id string, year_month_created_at string, item_id string, item_name string, sellings_qty long")
    tpv = spark.createDataFrame([("c", "2024-H2", "1", "B", 1.0), ("c", "2024-H1", "10", "B", 1.005), ("c", "2024-H1", "9", "B", None), ("c", "2024-H1", "5", "A", 2.0)], "client_id string, year_half_created_at string, store_id string, store_name string, tpv double")
    clients = spark.createDataFrame([("c", "B", "1990-01-01"), ("c", "A", "1991-01-01"), ("c", "A", "1980-01-01"), ("c", "A", "1985-01-01"), ("c", "A", "1999-01-01"), ("d", "A", None)], "client_id string, store_name string, birthdate string")
    S.write_results({S.BY_QUANTITY: items, S.TPV: tpv, S.CLIENTS: clients}, str(tmp_path / "out"))
    got = defaultdict(list)
    for r in sorted(read_lines(spark, str(tmp_path / "out")).collect(), key=lambda r: r["n"]):
        got[r["client_id"], r["file"]].append(r["line"])
    assert got["c", "top_items_by_quantity.txt"][4:] == ["year_month_created_at - item_name - sellings_qty", "2024-9 - nine - 5", "2024-10 - two - 7", "2024-10 - nine - 5", "2024-10 - ten - 5", "-" * 50]
    assert got["c", "tpv_summary.txt"][5:] == ["Sucursal 5 2024-H1 A: $2.00", "Sucursal 9 2024-H1 B: $0.00", "Sucursal 10 2024-H1 B: $1.01", "Sucursal 1 2024-H2 B: $1.00", "-" * 50]
    assert got["c", "top_clients_birthdays.txt"][4:] == ["TOP CLIENTES POR SUCURSAL (2024-2025)", "store_name - birthdate", "A - 1980-01-01", "A - 1985-01-01", "A - 1991-01-01", "B - 1990-01-01", "-" * 50]
    assert got["d", "top_clients_birthdays.txt"][4:] == ["TOP CLIENTES POR SUCURSAL (2024-2025)", "store_name - birthdate", "A - ", "-" * 50]
    assert got["d", "top_items_by_quantity.txt"][4:] == [S.NO_ROWS, "-" * 50] and len(got["c", "top_items_by_profit.txt"]) == 4 and len(got) == 10


def test_why_messages_are_dead(spark):
    good = {"client_id": "c", "message_uuid": "m", "data": [{"item_id": "1", "quantity": "2", "unit_price": "1", "subtotal": "2"}, {"item_id": "x", "quantity": "-", "unit_price": "1", "subtotal": "2"}]}
    texts = [json.dumps(good), "{", None, " ", "[1]", "null", "7", json.dumps({**good, "data": None}), json.dumps({**good, "data": 3}), json.dumps({**good, "data": []}), json.dumps({**good, "client_id": None})]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows, dead = I.split_messages(df, "transaction_items")
    assert sorted((r["client_id"] or "", r["row_no"], r["item_id"], r["quantity"]) for r in rows.collect()) == [("", 0, 1, 2), ("c", 0, 1, 2)]
    why = Counter(r["reason"] for r in dead.collect())
    assert why["empty text"] == 2 and why["item_id: not a int; quantity: not a int"] == 2 and sum(why.values()) == 2 + 2 + 4 + 2 + 0 and set(why) <= {"empty text", "not JSON", "no rows", "item_id: not a int; quantity: not a int"}


def test_files_are_admitted_by_size_and_once(spark, tmp_path):
    schema = "n long, pad string"
    for k in range(20):
        put(spark, [(k, "x" * 10)], schema, tmp_path / "in")
    size = max(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    read = lambda: J.file_stream(spark, str(tmp_path / "in"), schema, size=3 * size, archive=str(tmp_path / "done"))
    first = J.run_available(read(), str(tmp_path / "run"))
    assert sum(b["rows"] for b in first) == 20 and max(b["rows"] for b in first) <= 4 and len(first) >= 5
    put(spark, [(99, "y")], schema, tmp_path / "in")
    assert [b["rows"] for b in J.run_available(read(), str(tmp_path / "run"))] == [1]
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()) == [*range(20), 99]
    assert len(list((tmp_path / "done").rglob("*.parquet"))) >= 15  # the last batches' files wait for a later one
    ordered = J.order_of_files(spark.read.schema(schema).parquet(str(tmp_path / "in"), recursiveFileLookup=True))
    assert all(r["seq"].startswith("part-") for r in ordered.collect())


def test_own_accumulator_meets_no_whole_group(spark, tmp_path):
    class Longest(A.Accumulator):
        def init(self):
            return ""

        def add(self, state, rows):
            return max([state, *(v for v in rows["v"] if v is not None)], key=lambda v: (len(v), v))

        def merge(self, a, b):
            return max(a, b, key=lambda v: (len(v), v))

        def finish(self, state):
            return (state,)

    rows = [("hot", 1, "v" * (k % 50) + str(k % 7)) for k in range(4000)] + [("b", 2, None), ("c", None, "x"), (None, 3, "y"), ("d", 4, "z")]
    df = spark.createDataFrame(rows, "k string, j int, v string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r["k"], r["j"]): r["v_max"] for r in A.accumulate_with(df, ["k", "j"], ["v"], Longest(), "v_max string", fan=4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = max((v for k, _, v in rows if k == "hot"), key=lambda v: (len(v), v))
    assert got == {("hot", 1): best, ("b", 2): "", ("d", 4): "z"}
    assert A.accumulate_with(df.where("false"), ["k"], ["v"], Longest(), "v_max string").count() == 0


def test_checking_scan_and_counts_of_rules(spark, tmp_path):
    (tmp_path / "transactions").mkdir()
    head = "transaction_id, store_id,payment_method_id,voucher_id,user_id,original_amount,discount_applied,final_amount,created_at\n"
    (tmp_path / "transactions" / "tx_202401.csv").write_text(head + "t1,1,1,,,1,0,5.5,2024-01-05 10:00:00\nt2,-1,x,,u,,,,bad\n")
    (tmp_path / "transactions" / "tx_202402.csv").write_text(head + "t3,2,1,,7,1,0,,2024-02-05T10:00\n")
    rows = I.checking_scan(spark, str(tmp_path), "transactions")
    assert {r["transaction_id"]: str(r["created_at"]) for r in rows.collect()} == {"t1": "2024-01-05 10:00:00", "t2": "None", "t3": "2024-02-05 10:00:00"}
    assert I.read_csv(spark, str(tmp_path), "transactions", QueryConfig(reduced=True)).count() == 2 and I.read_csv(spark, str(tmp_path), "transactions", QueryConfig()).count() == 3
    assert QueryConfig.from_environment({"REDUCED": "no"}).reduced is False and QueryConfig.from_environment({}).reduced is True
    got = {r["transaction_id"]: r["_failed"] for r in I.typed(I.read_csv(spark, str(tmp_path), "transactions"), "transactions")[1].collect()}
    assert got == {"t2": ["store_id: not a int", "payment_method_id: not a int", "user_id: not a bigint"]}
