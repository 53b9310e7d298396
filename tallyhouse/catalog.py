"""The registered queries of the core library, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyhouse.config import QueryConfig
from tallyhouse.functions import columns as C
from tallyhouse.operators import aggregate as A, filters as L, quality as V, ranking as R, results as S, rollup as U
from tallyhouse.operators.dimensions import Dimension, lookup
from tallyhouse.operators.kept import KeptDimension
from tallyhouse.plans import adapters as D, questions as Q
from tallyhouse.sinks.result_files import read_lines
from tallyhouse.sources import ingest as I
from tallyhouse.streaming import jobs as J, keyed as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The model's entities in SQL.
TA = "ta as (select o_orderkey transaction_id, c_nationkey store_id, o_custkey user_id, o_totalprice final_amount, o_orderdate + to_minutes(cast(o_orderkey * 37 % 1440 as bigint)) created_at from orders join customer on o_custkey = c_custkey)"
TB = "tb as (select event_id transaction_id, cast(event_id % 25 as integer) store_id, case when event_type = 'error' then 0 else user_id end user_id, value final_amount, date_trunc('second', ts) created_at from events)"
IT = "it as (select l_orderkey transaction_id, l_partkey item_id, cast(trunc(l_quantity) as bigint) quantity, l_extendedprice subtotal, l_shipdate created_at from lineitem)"
FA = "fa as (select * from ta where year(created_at) in (1997, 1998) and cast(created_at as time) between time '06:00:00' and time '23:00:00')"
FB = "fb as (select * from tb where year(created_at) in (2024, 2025))"
HALF = "year(created_at) || case when month(created_at) <= 6 then '-H1' else '-H2' end"
MONTH = "strftime(created_at, '%Y-%m')"
TPV = f"tpv as (select {HALF} year_half_created_at, store_id, cast(sum(cast(final_amount as decimal(18,6))) as double) tpv from fa group by all)"
TOT = f"tot as (select {MONTH} year_month_created_at, item_id, cast(sum(quantity) as bigint) sellings_qty, cast(sum(cast(subtotal as decimal(18,6))) as double) profit_sum from it where year(created_at) in (1997, 1998) group by all)"
CNT = "cnt as (select store_id, user_id, count(*) purchases_qty from fb group by all)"
BORN = "cast(date '1960-01-01' + cast(c_custkey * 13 % 16000 as integer) as varchar)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _clients(ranked: str) -> str:
    return f"select user_id, store_id, coalesce(n_name, 'Unknown Store') store_name, coalesce({BORN}, 'Unknown Birthday') birthdate, purchases_qty from ({ranked}) left join customer on user_id = c_custkey left join nation on store_id = n_nationkey where user_id > 0"


def _best(function: str, where: str = "user_id > 0", tie: str = ", user_id", n: int = 3) -> str:
    return f"select * from (select *, {function}() over (partition by store_id order by purchases_qty desc{tie}) r from cnt where {where}) where r <= {n}"


def _items(metric: str, n: int = 1) -> str:
    return f"with {IT}, {TOT} select year_month_created_at, item_id, coalesce(p_name, 'Unknown Item') item_name, {metric} from (select *, row_number() over (partition by year_month_created_at order by {metric} desc, item_id) r from tot) left join part on item_id = p_partkey where r <= {n}"


Q1_SQL = f"with {TA}, {FA} select transaction_id, store_id, user_id, final_amount, created_at from fa where final_amount >= 250000"
Q3_SQL = f"with {TA}, {FA}, {TPV} select year_half_created_at, store_id, coalesce(n_name, 'Unknown Store') store_name, tpv from tpv left join nation on store_id = n_nationkey"


@query(Q1_SQL)
def q1_amount_filter(s, d):
    return Q.amount_filter(D.order_transactions(s, d, D.ORDERS), D.ORDERS)


@query(Q1_SQL)
def q1_dedup(s, d):
    t = D.order_transactions(s, d, D.ORDERS)
    return Q.amount_filter(t.unionByName(t), D.ORDERS)


@query(_items("sellings_qty"))
def q2_top_qty(s, d):
    return Q.top_items(D.items(s, d), D.menu(s, d), "sellings_qty", D.ORDERS)


@query(_items("profit_sum"))
def q2_top_profit(s, d):
    return Q.top_items(D.items(s, d), D.menu(s, d), "profit_sum", D.ORDERS)


@query(_items("sellings_qty", 3))
def q2_topn_3(s, d):
    return Q.top_items(D.items(s, d), D.menu(s, d), "sellings_qty", replace(D.ORDERS, top_items=3))


@query(Q3_SQL)
def q3_tpv(s, d):
    return R.order_tpv(Q.payment_value(D.order_transactions(s, d, D.ORDERS), D.stores(s, d), D.ORDERS))


@query(f"select year_half_created_at, cast(store_id as varchar) store_id, store_name, tpv, cast(substr(year_half_created_at, 1, 4) as integer) as year, 'H' || right(year_half_created_at, 1) semester from ({Q3_SQL})")
def q3_tpv_normalized(s, d):
    return Q.normalized_payment_value(Q.payment_value(D.order_transactions(s, d, D.ORDERS), D.stores(s, d), D.ORDERS))


def _top_clients(s, d, **change):
    return Q.top_clients(D.event_transactions(s, d, D.EVENTS), D.users(s, d), D.stores(s, d), replace(D.EVENTS, **change))


@query(f"with {TB}, {FB}, {CNT} {_clients(_best('row_number'))}")
def q4_top_clients(s, d):
    return R.order_clients(_top_clients(s, d))


@query(f"with {TB}, {FB}, {CNT} {_clients(_best('rank', tie=''))}")
def q4_ties_rank(s, d):
    return _top_clients(s, d, ties="rank")


@query(f"with {TB}, {FB}, {CNT} {_clients(_best('dense_rank', tie=''))}")
def q4_ties_dense(s, d):
    return _top_clients(s, d, ties="dense_rank")


@query(f"with {TB}, {FB}, {CNT} {_clients(_best('row_number', where='true'))}")
def q4_compat_anonymous(s, d):
    return _top_clients(s, d, compat_anonymous=True)


@query(f"with {TA} select transaction_id, created_at from ta where year(created_at) in (1996, 1999)")
def flt_year_set(s, d):
    return D.order_transactions(s, d).where(L.year_in("created_at", (1996, 1999))).select("transaction_id", "created_at")


@query(f"with {TA} select transaction_id, created_at from ta where cast(created_at as time) between time '06:00:00' and time '23:00:00'")
def flt_time(s, d):
    return D.order_transactions(s, d).where(L.time_between("created_at", "06:00:00", "23:00:00")).select("transaction_id", "created_at")


@query(f"with {TA} select transaction_id, final_amount from ta where final_amount >= 250000")
def flt_amount(s, d):
    return D.order_transactions(s, d).where(L.amount_at_least("final_amount", 250000.0, typed=True)).select("transaction_id", "final_amount")


@query(f"with {TB}, {FB}, {CNT} select store_id, user_id, purchases_qty from cnt where user_id > 0 and purchases_qty > 0")
def flt_valid_rank_rows(s, d):
    counts = A.purchase_counts(D.event_transactions(s, d, D.EVENTS).where(L.year_in("created_at", D.EVENTS.years)))
    return L.rankable(counts)


@query(f"with {TA} select store_id, count(*) n from ta where store_id is not null group by all")
def flt_has_key(s, d):
    return L.has_key(D.order_transactions(s, d), "store_id").groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TB}, {FB}, {CNT} select * from cnt")
def agg_purchase_count(s, d):
    return A.purchase_counts(D.event_transactions(s, d, D.EVENTS).where(L.year_in("created_at", D.EVENTS.years)))


@query(f"with {TA}, {FA}, {TPV} select * from tpv")
def agg_tpv(s, d):
    t = D.order_transactions(s, d, D.ORDERS)
    t = L.keep(t, L.year_in("created_at", D.ORDERS.years), L.time_between("created_at", "06:00:00", "23:00:00"))
    return A.payment_value(t).withColumn("tpv", F.col("tpv").cast("double"))


@query(f"with {IT}, {TOT} select * from tot")
def agg_items_both(s, d):
    return A.item_totals(D.items(s, d).where(L.year_in("created_at", D.ORDERS.years))).withColumn("profit_sum", F.col("profit_sum").cast("double"))


@query(f"with {IT}, {TOT} select * from tot")
def agg_mergeable_rollup(s, d):
    rows = D.items(s, d).where(L.year_in("created_at", D.ORDERS.years)).withColumn("day", F.to_date("created_at"))
    daily = rows.groupBy("day", C.year_month("created_at").alias("year_month_created_at"), "item_id").agg(F.sum("quantity").alias("sellings_qty"), A.money_sum("subtotal").alias("profit_sum"))
    return A.merge_partials(daily, ["year_month_created_at", "item_id"], ["sellings_qty", "profit_sum"]).withColumn("profit_sum", F.col("profit_sum").cast("double"))


@query(f"with {IT}, {TOT} select year_month_created_at, cast(item_id as integer) item_id, sellings_qty from tot")
def agg_nested_merge(s, d):
    totals = A.item_totals(D.items(s, d).where(L.year_in("created_at", D.ORDERS.years)))
    half = totals.withColumn("part", F.floor(F.col("item_id") / 100))  # a bundle holds at most 100 items
    months = half.groupBy("part", "year_month_created_at").agg(F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), F.col("sellings_qty").cast("string")))).alias("m"))
    nested = months.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("year_month_created_at", "m"))).alias("bundle"))
    return A.merge_nested(nested, "bundle", "sellings_qty").withColumn("sellings_qty", F.col("sellings_qty").cast("bigint"))


@query(f"with {TA} select transaction_id, store_id, case when n_nationkey < 20 then n_name else 'Unknown Store' end store_name from ta left join nation on store_id = n_nationkey")
def join_default_miss(s, d):
    some = Dimension(D.table(s, d, "nation").where("n_nationkey < 20"), "n_nationkey", "n_name", "Unknown Store")
    return lookup(D.order_transactions(s, d).select("transaction_id", "store_id"), some, "store_id", "store_name")


@query(f"with {TA} select transaction_id, store_id, 'new ' || n_name store_name from ta left join nation on store_id = n_nationkey")
def join_last_write_wins(s, d):
    nation = D.table(s, d, "nation").select("n_nationkey", "n_name")
    twice = nation.withColumn("seq", F.lit(1)).unionByName(nation.select("n_nationkey", F.concat(F.lit("new "), "n_name").alias("n_name"), F.lit(2).alias("seq")))
    return lookup(D.order_transactions(s, d).select("transaction_id", "store_id"), Dimension(twice, "n_nationkey", "n_name", "Unknown Store", order=("seq",)), "store_id", "store_name")


@query(f"with {TA} select transaction_id, {HALF} year_half from ta")
def fn_year_half(s, d):
    return D.order_transactions(s, d).select("transaction_id", C.year_half("created_at").alias("year_half"))


@query(f"with {TA} select transaction_id, {MONTH} year_month, cast(year(created_at) as integer) as year, cast(month(created_at) as integer) as month from ta")
def fn_year_month(s, d):
    m = C.normalized_month(F.concat_ws("-", F.year("created_at").cast("string"), F.month("created_at").cast("string")))
    return D.order_transactions(s, d).select("transaction_id", m["text"].alias("year_month"), m["year"].alias("year"), m["month"].alias("month"))


@query("select n_nationkey, cast((cast('0x' || md5(cast(n_nationkey as varchar)) as uhugeint)) % 7 as integer) shard from nation")
def fn_shard_id(s, d):
    return D.table(s, d, "nation").select("n_nationkey", C.shard_id("n_nationkey", 7).alias("shard"))


@query("select event_id, coalesce(try_cast(payload as double), 0.0) as number, cast(coalesce(trunc(try_cast(payload as double)), 0) as bigint) as whole from (select event_id, case event_id % 4 when 0 then cast(value as varchar) when 1 then cast(event_id as varchar) when 2 then 'abc' else '' end payload from events)")
def fn_safe_casts(s, d):
    text = F.when(F.pmod("event_id", F.lit(4)) == 0, F.col("value").cast("string")).when(F.pmod("event_id", F.lit(4)) == 1, F.col("event_id").cast("string")).when(F.pmod("event_id", F.lit(4)) == 2, "abc").otherwise("")
    return D.table(s, d, "events").select("event_id", C.safe_double(text).alias("number"), C.safe_long(text).alias("whole"))


@query(f"""select 'TPV_SUMMARY' result_type, year_half_created_at, store_name, tpv, null::varchar item_name, null::bigint sellings_qty from ({Q3_SQL})
union all select 'TOP_ITEMS_BY_QUANTITY', null, null, null, item_name, sellings_qty from ({_items("sellings_qty")})""")
def res_union_tagged(s, d):
    return S.tagged({S.TPV: q3_tpv(s, d), S.BY_QUANTITY: q2_top_qty(s, d)}).select("result_type", "year_half_created_at", "store_name", "tpv", "item_name", "sellings_qty")


@query(f"select 'TPV_SUMMARY' result_type, count(*) n from ({Q3_SQL}) union all select 'TOP_ITEMS_BY_PROFIT', count(*) from ({_items('profit_sum')}) union all select 'AMOUNT_FILTER_TRANSACTIONS', count(*) from ({Q1_SQL})")
def res_classify(s, d):
    rows = q3_tpv(s, d).unionByName(q2_top_profit(s, d), allowMissingColumns=True).unionByName(q1_amount_filter(s, d).select("transaction_id", "final_amount"), allowMissingColumns=True)
    return S.classified(rows).groupBy("result_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TA} select cast(store_id as varchar) client_id, case when store_id % 2 = 0 then 'AMOUNT_FILTER_TRANSACTIONS,TOP_CLIENTS_BIRTHDAYS,TOP_ITEMS_BY_PROFIT,TOP_ITEMS_BY_QUANTITY,TPV_SUMMARY' else 'AMOUNT_FILTER_TRANSACTIONS,TPV_SUMMARY' end seen, store_id % 2 = 0 complete from ta group by store_id")
def res_completion(s, d):
    t = D.order_transactions(s, d)
    kinds = F.when(F.pmod("store_id", F.lit(2)) == 0, F.array(*map(F.lit, S.TYPES))).otherwise(F.array(F.lit(S.AMOUNT), F.lit(S.TPV)))
    return S.completion(t.select(F.col("store_id").cast("string").alias("client_id"), F.explode(kinds).alias("result_type")))


@query(f"select transaction_id || ' - ' || cast(cast(round(cast(final_amount as decimal(18,6)), 2) as decimal(18,2)) as varchar) line from ({Q1_SQL})")
def snk_lines_q1(s, d):
    return S.lines_amount(q1_amount_filter(s, d))


@query(f"select year_month_created_at || ' - ' || item_name || ' - ' || sellings_qty line from ({_items('sellings_qty')})")
def snk_lines_q2(s, d):
    return S.lines_items(q2_top_qty(s, d), "sellings_qty")


@query(f"select 'Sucursal ' || store_id || ' ' || year_half_created_at || ' ' || store_name || ': $' || cast(cast(round(cast(tpv as decimal(18,6)), 2) as decimal(18,2)) as varchar) line from ({Q3_SQL})")
def snk_lines_q3(s, d):
    return S.lines_tpv(q3_tpv(s, d))


@query(f"select store_name || ' - ' || birthdate line from (select *, row_number() over (partition by store_name order by birthdate) r from (with {TB}, {FB}, {CNT} {_clients(_best('rank', tie=''))})) where r <= 3")
def snk_lines_q4_cap(s, d):
    return S.lines_clients(q4_ties_rank(s, d))


@query(f"select count(*) n, cast(sum(tpv) > 0 as boolean) positive from ({Q3_SQL})")
def snk_envelope(s, d):
    value = S.envelopes(q3_tpv(s, d), S.TPV)
    rows = value.select(F.explode(F.from_json("value", "type string, results array<struct<tpv double>>")["results"]).alias("r"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.sum("r.tpv") > 0).alias("positive"))


@query(f"select 'Q1' label, false ok, count(*) mismatches, cast(0 as bigint) size_difference from ({Q1_SQL}) where transaction_id % 10 = 0")
def val_q1_report(s, d):
    right = q1_amount_filter(s, d).select("transaction_id", "final_amount")
    wrong = right.withColumn("final_amount", F.col("final_amount") + F.when(F.pmod("transaction_id", F.lit(10)) == 0, 1.0).otherwise(0.001))
    return V.report({"Q1": (V.mismatches(wrong, right, ["transaction_id"], "final_amount", atol=0.01), wrong, right)})


@query(f"with {TB}, {FB}, {CNT} select store_id, user_id from cnt where user_id > 0 and user_id % 2 = 0 except select store_id, user_id from ({_best('rank', tie='')})")
def val_q4_membership(s, d):
    counts = agg_purchase_count(s, d)
    return V.outside_top(counts.where("user_id > 0 and user_id % 2 = 0").select("store_id", "user_id"), counts)


#: Bytes of a batch, about: by size, so that rows in many files take no more batches than the same in one.
BATCH = 256 << 20


def _stream(s, d, name):
    # A pattern, since the source takes a plain path for a folder while a table may be one file.
    return J.file_stream(s, f"{d}/{name}.parque[t]", D.table(s, d, name).schema, size=BATCH)


def _events(stream):
    return stream.select(
        F.col("event_id").alias("transaction_id"), F.pmod("event_id", F.lit(25)).cast("int").alias("store_id"), F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.col("user_id")).cast("bigint").alias("user_id"),
        F.col("value").alias("final_amount"), F.col("ts").alias("created_at"),
    )


@query(f"with {TB} select {HALF} year_half_created_at, store_id, cast(sum(cast(final_amount as decimal(18,6))) as double) tpv from tb where year(created_at) in (2024, 2025) and cast(created_at as time) between time '06:00:00' and time '23:00:00' group by all")
def stream_tpv_available_now(s, d):
    folder = J.fresh_folder(s, "tpv")
    J.run_available(J.running_payment_value(_events(_stream(s, d, "events")), D.EVENTS), folder, "update")
    return J.latest(s, folder, ["year_half_created_at", "store_id"]).withColumn("tpv", F.col("tpv").cast("double"))


@query("select event_id from events")
def stream_dedup(s, d):
    folder = J.fresh_folder(s, "dedup")
    stream = _stream(s, d, "events").select("event_id", F.col("ts").alias("created_at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    J.run_available(J.without_repeats(stream, ["event_id"]).select("event_id"), folder)
    return s.read.parquet(f"{folder}/out").select("event_id")


@query(f"with {TB}, {FB}, {CNT} {_best('row_number')}".replace("select * from (select *", "select store_id, user_id, purchases_qty, cast(r as integer) as rank from (select *"))
def stream_top_clients(s, d):
    """Ranking kept over changed counts, as it is in the end."""
    folder = J.fresh_folder(s, "clients")
    counts = J.running_purchase_counts(_events(_stream(s, d, "events")), D.EVENTS).where("user_id > 0")
    J.run_ranking(counts, folder, ["store_id"], "user_id", "purchases_qty", 3)
    return J.kept_ranking(s, folder)


def _messages(s, d):
    """Events as messages of 5 clients, each sent again with another amount; every 25th has an empty id or none."""
    name = F.when(F.pmod("event_id", F.lit(50)) == 0, F.lit(None)).when(F.pmod("event_id", F.lit(25)) == 0, "").otherwise(F.concat(F.lit("m"), F.col("event_id").cast("string")))
    e = _stream(s, d, "events").select("event_id", "value", F.pmod("event_id", F.lit(5)).cast("string").alias("client_id"))
    data = F.struct(F.lit("data").alias("kind"), name.alias("message_uuid"), F.floor("value").cast("double").alias("amount"), (F.col("event_id") * 10).cast("bigint").alias("seq"))
    again = F.struct(F.lit("data").alias("kind"), name.alias("message_uuid"), F.lit(1e6).alias("amount"), (F.col("event_id") * 10 + 1).cast("bigint").alias("seq"))
    return e.select("client_id", F.explode(F.array(data, again)).alias("r")).select("client_id", "r.*")


def _control(s, d, reset: bool):
    """A marker from each of 3 senders for every client, once; with reset, what an earlier half said is void."""
    clients = D.table(s, d, "events").select(F.pmod("event_id", F.lit(5)).cast("string").alias("client_id")).distinct()
    late = F.lit(10**15).cast("bigint")
    rows = [F.struct(F.lit("EOF").alias("kind"), F.lit(f"eof{k}").alias("message_uuid"), F.lit(0.0).alias("amount"), late.alias("seq")) for k in (0, 1, 2)]
    if reset:
        rows.append(F.struct(F.lit("CLIENT_RESET").alias("kind"), F.lit("").alias("message_uuid"), F.lit(0.0).alias("amount"), F.lit(3005).cast("bigint").alias("seq")))
    return clients.select("client_id", F.explode(F.array(*rows)).alias("r")).select("client_id", "r.*")


def _completed(s, d, reset: bool):
    folder = J.fresh_folder(s, "barrier")
    control = _control(s, d, reset)
    control.where("false").write.parquet(f"{folder}/control")
    stream = _messages(s, d).unionByName(J.file_stream(s, f"{folder}/control", control.schema))
    J.run_barrier(stream, folder, 3)
    # All data came; now the senders say so, and the stream goes on where it stopped.
    control.write.mode("append").parquet(f"{folder}/control")
    J.run_barrier(stream, folder, 3)
    return s.read.parquet(f"{folder}/out").select("client_id", "amount", "n_rows")


@query("select cast(event_id % 5 as varchar) client_id, sum(floor(value)) + 1000000 * count(case when event_id % 25 = 0 then 1 end) amount, count(*) + count(case when event_id % 25 = 0 then 1 end) n_rows from events group by all")
def stream_barrier(s, d):
    return _completed(s, d, False)


@query("select cast(event_id % 5 as varchar) client_id, sum(floor(value)) + 1000000 * count(case when event_id % 25 = 0 then 1 end) amount, count(*) + count(case when event_id % 25 = 0 then 1 end) n_rows from events where event_id * 10 > 3005 group by all")
def stream_reset(s, d):
    return _completed(s, d, True)


@query(f"with {TA} select transaction_id, case transaction_id % 6 when 0 then 'AMOUNT_FILTER_TRANSACTIONS' when 1 then 'TOP_ITEMS_BY_PROFIT' when 2 then null when 3 then 'TPV_SUMMARY' when 4 then 'TOP_CLIENTS_BIRTHDAYS' end result_type from ta")
def res_classify_order(s, d):
    """Rows with columns of several types: the first type that fits counts; sums without a month and counts without a user fit none."""
    t = D.order_transactions(s, d)
    at = lambda *k: F.pmod("transaction_id", F.lit(6)).isin(*k)
    text, one = F.lit("x"), F.lit(1)
    rows = t.select(
        F.col("transaction_id").alias("number"), F.when(at(0), F.col("transaction_id")).alias("transaction_id"), F.when(at(0, 2), one).alias("sellings_qty"), F.when(at(0, 1), text).alias("year_month_created_at"), F.when(at(1), one).alias("profit_sum"),
        F.when(at(3), text).alias("store_name"), F.when(at(3, 4), one).alias("user_id"), F.when(at(3, 4, 5), one).alias("purchases_qty"),
    )
    return S.classified(rows).select(F.col("number").alias("transaction_id"), "result_type")


@query("select case when event_id % 3 = 0 then null else user_id % 7 end k, cast(sum(cast(value as decimal(18,6))) as double) total from events group by all")
def agg_null_group(s, d):
    keyed = D.table(s, d, "events").select(F.when(F.pmod("event_id", F.lit(3)) != 0, F.pmod("user_id", F.lit(7)).cast("long")).alias("k"), "value")
    return A.sums(keyed, ["k"], "value", "total").withColumn("total", F.col("total").cast("double"))


@query(f"with {TA} select store_id, count(*) n, max(final_amount) largest from ta group by all")
def agg_accumulate(s, d):
    return A.accumulate(D.order_transactions(s, d), ["store_id"], {"n": "count(1)", "largest": F.max("final_amount")})


@query(f"with {TA} select cast(transaction_id as varchar) transaction_id, strftime(created_at, '%Y-%m') year_month, strftime(created_at, '%Y') || case when month(created_at) <= 6 then '-H1' else '-H2' end year_half from ta")
def fn_moment_text(s, d):
    """Months and half-years of text with and without leading zeros."""
    t, c = D.order_transactions(s, d), F.col("created_at")
    text = F.when(F.pmod("transaction_id", F.lit(2)) == 0, F.date_format(c, "yyyy-M-d H:m:s")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return t.select(F.col("transaction_id").cast("string").alias("transaction_id"), C.year_month_text(text).alias("year_month"), C.year_half_text(text).alias("year_half"))


@query(f"with {TA} select cast(transaction_id as varchar) transaction_id, store_id, user_id, final_amount, strftime(created_at, '%Y-%m-%d %H:%M:%S') created_at, 'c1' client_id from ta")
def src_csv_transactions(s, d):
    """Transactions written out as CSV with blanks in names and values, and read back typed."""
    folder = J.fresh_folder(s, "csv")
    t = D.order_transactions(s, d)
    text = t.select(
        F.col("transaction_id").cast("string").alias("transaction_id"), F.concat(F.lit(" "), F.col("store_id").cast("string"), F.lit(" ")).alias(" store_id"), F.lit("1").alias("payment_method_id"), F.lit(None).cast("string").alias("voucher_id"),
        F.col("user_id").cast("string").alias("user_id"), F.lit("").alias("original_amount"), F.lit("0").alias("discount_applied"), F.col("final_amount").cast("string").alias("final_amount"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/transactions")
    rows, _ = I.typed(I.read_csv(s, folder, "transactions", client_id="c1"), "transactions")
    return rows.select("transaction_id", "store_id", "user_id", "final_amount", "created_at", "client_id")


@query(f"with {IT} select cast(transaction_id as varchar) transaction_id, item_id, cast(quantity as integer) quantity, subtotal from it")
def src_messages(s, d):
    """Items as JSON messages, one for each order, and read back typed."""
    item = F.struct(F.col("transaction_id").cast("string").alias("transaction_id"), F.col("item_id").cast("string").alias("item_id"), F.col("quantity").cast("string").alias("quantity"), F.lit("1.0").alias("unit_price"), F.col("subtotal").cast("string").alias("subtotal"))
    sent = D.items(s, d).groupBy("transaction_id").agg(F.collect_list(item).alias("data"))
    value = F.to_json(F.struct(F.lit("c1").alias("client_id"), F.col("transaction_id").cast("string").alias("message_uuid"), "data"))
    rows, _ = I.typed(I.messages(sent.select(value.alias("value")), "transaction_items"), "transaction_items")
    return rows.select("transaction_id", F.col("item_id").cast("bigint").alias("item_id"), "quantity", "subtotal")


@query(_items("profit_sum", 3))
def q2_ordered(s, d):
    return R.order_items(Q.top_items(D.items(s, d), D.menu(s, d), "profit_sum", replace(D.ORDERS, top_items=3)), "profit_sum")


@query(f"with {TA} select transaction_id, cast(store_id as varchar) client_id from ta where store_id % 3 = 0")
def gate_complete(s, d):
    """Rows of clients whose stores and users both came to their end."""
    t = D.order_transactions(s, d).select("transaction_id", F.col("store_id").cast("string").alias("client_id"))
    came = F.when(F.pmod(F.col("client_id").cast("int"), F.lit(3)) == 0, F.array(F.lit("stores"), F.lit("users"))).otherwise(F.array(F.lit("stores"), F.lit("stores")))
    return S.gated(t, t.select("client_id", F.explode(came).alias("input")), ["stores", "users"])


@query(f"with {IT}, {TOT} select * from tot")
def stream_items(s, d):
    folder = J.fresh_folder(s, "items")
    rows = _stream(s, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_extendedprice").alias("subtotal"), F.col("l_shipdate").alias("created_at"))
    J.run_available(J.running_item_totals(rows, D.ORDERS), folder, "update")
    return J.latest(s, folder, ["year_month_created_at", "item_id"]).withColumn("profit_sum", F.col("profit_sum").cast("double"))


@query(f"with {TB} select transaction_id, store_id, 'new ' || n_name store_name from tb join nation on store_id = n_nationkey")
def stream_enriched(s, d):
    folder = J.fresh_folder(s, "enriched")
    nation = D.table(s, d, "nation").select("n_nationkey", "n_name")
    twice = nation.withColumn("seq", F.lit(1)).unionByName(nation.select("n_nationkey", F.concat(F.lit("new "), "n_name").alias("n_name"), F.lit(2).alias("seq")))
    named = J.enriched(_events(_stream(s, d, "events")), Dimension(twice, "n_nationkey", "n_name", "Unknown Store", order=("seq",)), "store_id", "store_name")
    J.run_available(named.select("transaction_id", "store_id", "store_name"), folder)
    return s.read.parquet(f"{folder}/out").select("transaction_id", "store_id", "store_name")


@query(f"select 'c' || (store_id % 3) client_id, transaction_id, final_amount from ({Q1_SQL})")
def snk_envelope_q1(s, d):
    """Q1 in envelopes of at most 100 rows for three clients, read back."""
    rows = q1_amount_filter(s, d).select(F.concat(F.lit("c"), F.pmod("store_id", F.lit(3)).cast("string")).alias("client_id"), "transaction_id", "final_amount")
    sent = S.envelopes(rows, S.AMOUNT, 100)
    read = F.from_json("value", "type string, client_id string, results array<struct<transaction_id bigint, final_amount double>>")
    return sent.select(read.alias("e")).select("e.client_id", F.explode("e.results").alias("r")).select("client_id", "r.transaction_id", "r.final_amount")


@query("select o_orderkey, cast((cast('0x' || md5(cast(o_orderkey as varchar)) as uhugeint)) % 7 as integer) shard from orders")
def fn_shard_orders(s, d):
    return D.table(s, d, "orders").select("o_orderkey", C.shard_id("o_orderkey", 7).alias("shard"))


def _report_row(label: str, keys: str, bad: str, sizes: str = "0", order: str | None = None) -> str:
    return f"""select '{label}' label, (select count(*) from ({bad})) = 0 ok, (select count(*) from ({bad})) mismatches, cast({sizes} as bigint) size_difference,
coalesce((select string_agg(k, ', ' order by n) from (select {keys} k, row_number() over (order by {order or keys}) n from ({bad})) where n <= 3), '') as first"""


@query(" union all ".join([
    _report_row("Q1", "cast(transaction_id as varchar)", f"select * from ({Q1_SQL}) where transaction_id % 10 = 0", order="transaction_id"),
    _report_row("Q2a", "year_month_created_at || ' ' || item_name", f"select * from ({SQL['q2_top_qty']}) where year_month_created_at like '%-01'", f"-(select count(*) from ({SQL['q2_top_qty']}) where year_month_created_at like '%-01')"),
    _report_row("Q2b", "year_month_created_at || ' ' || item_name", f"select * from ({SQL['q2_top_profit']}) where year_month_created_at like '%-02'"),
    _report_row("Q3", "year_half_created_at || ' ' || store_name", "select * from (select 1 year_half_created_at, '' store_name) where false"),
    _report_row("Q4", "store_id || ' ' || user_id || ' 1900-01-01'", f"select * from ({SQL['q4_top_clients']}) where store_id = 5", order="store_id, purchases_qty desc, user_id"),
]))
def val_report_all(s, d):
    """Results with planted differences: amounts of Q1, months without Q2a, profits of Q2b, cents in Q3 (allowed), birthdates of Q4."""
    q1, q2a, q2b, q3, q4 = q1_amount_filter(s, d), q2_top_qty(s, d), q2_top_profit(s, d), q3_tpv(s, d), q4_top_clients(s, d)
    actual = {
        "Q1": q1.withColumn("final_amount", F.col("final_amount") + F.when(F.pmod("transaction_id", F.lit(10)) == 0, 1.0).otherwise(0.001)),
        "Q2a": q2a.where("year_month_created_at not like '%-01'"),
        "Q2b": q2b.withColumn("profit_sum", F.col("profit_sum") + F.when(F.col("year_month_created_at").like("%-02"), 1.0).otherwise(0.1)),
        "Q3": q3.withColumn("tpv", F.col("tpv") + 0.1),
        "Q4": q4.withColumn("birthdate", F.when(F.col("store_id") == 5, "1900-01-01").otherwise(F.col("birthdate"))),
    }
    return V.full_report(actual, {"Q1": q1, "Q2a": q2a, "Q2b": q2b, "Q3": q3, "Q4": q4_ties_rank(s, d)})


@query("select cast(event_id % 5 as varchar) client_id, case when event_id % 100 > 0 then event_id end transaction_id, value final_amount from events union all select cast(event_id % 5 as varchar), null, value from events where event_id % 100 = 0")
def stream_delivery(s, d):
    """Events as Q1 rows of 5 clients, each sent twice and delivered once; rows without an id are no repeats."""
    folder = J.fresh_folder(s, "delivery")
    name = F.when(F.pmod("event_id", F.lit(100)) > 0, F.col("event_id"))
    rows = _stream(s, d, "events").select(F.pmod("event_id", F.lit(5)).cast("string").alias("client_id"), name.alias("transaction_id"), F.col("value").alias("final_amount"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    J.deliver(rows.drop("copy"), folder, ["transaction_id"])
    return J.delivered(s, folder).select(F.col("client_id").cast("string").alias("client_id"), "transaction_id", "final_amount")


#: Lines around the rows of result files, spelled out: file, block, place, whether they need rows (null: no matter).
AROUND = """a(file, block, place, wants, line) as (values
('amount_filter_transactions.txt', -1, 0, null::boolean, repeat('=', 60)), ('amount_filter_transactions.txt', -1, 1, null, 'Transacciones (Id y monto) realizadas durante 2024 y 2025'),
('amount_filter_transactions.txt', -1, 2, null, 'entre las 06:00 AM y las 11:00 PM con monto total >= $75'), ('amount_filter_transactions.txt', -1, 3, null, repeat('=', 60)), ('amount_filter_transactions.txt', -1, 4, null, ''),
('top_items_by_quantity.txt', -1, 0, null, repeat('=', 60)), ('top_items_by_quantity.txt', -1, 1, null, 'TOP ÍTEMS POR CANTIDAD (2024-2025, 06:00-23:00)'), ('top_items_by_quantity.txt', -1, 2, null, repeat('=', 60)), ('top_items_by_quantity.txt', -1, 3, null, ''),
('top_items_by_quantity.txt', 0, 0, true, 'year_month_created_at - item_name - sellings_qty'), ('top_items_by_quantity.txt', 0, 0, false, 'Sin registros que cumplan las condiciones.'), ('top_items_by_quantity.txt', 2, 0, null, repeat('-', 50)),
('top_items_by_profit.txt', -1, 0, null, repeat('=', 60)), ('top_items_by_profit.txt', -1, 1, null, 'TOP ÍTEMS POR GANANCIA (2024-2025, 06:00-23:00)'), ('top_items_by_profit.txt', -1, 2, null, repeat('=', 60)), ('top_items_by_profit.txt', -1, 3, null, ''),
('top_items_by_profit.txt', 0, 0, true, 'year_month_created_at - item_name - profit_sum'), ('top_items_by_profit.txt', 0, 0, false, 'Sin registros que cumplan las condiciones.'), ('top_items_by_profit.txt', 2, 0, null, repeat('-', 50)),
('tpv_summary.txt', -1, 0, null, repeat('=', 60)), ('tpv_summary.txt', -1, 1, null, 'RESUMEN TPV POR SEMESTRE Y SUCURSAL (2024-2025)'), ('tpv_summary.txt', -1, 2, null, 'Transacciones entre las 06:00 y las 23:00'), ('tpv_summary.txt', -1, 3, null, repeat('=', 60)), ('tpv_summary.txt', -1, 4, null, ''),
('tpv_summary.txt', 0, 0, false, 'Sin registros que cumplan las condiciones para calcular TPV.'), ('tpv_summary.txt', 2, 0, null, repeat('-', 50)),
('top_clients_birthdays.txt', -1, 0, null, repeat('=', 60)), ('top_clients_birthdays.txt', -1, 1, null, 'Cumpleaños de los clientes con más compras por sucursal (2024-2025)'), ('top_clients_birthdays.txt', -1, 2, null, repeat('=', 60)), ('top_clients_birthdays.txt', -1, 3, null, ''),
('top_clients_birthdays.txt', 0, 0, null, 'TOP CLIENTES POR SUCURSAL (2024-2025)'), ('top_clients_birthdays.txt', 0, 1, true, 'store_name - birthdate'), ('top_clients_birthdays.txt', 0, 1, false, 'Sin registros que cumplan las condiciones.'), ('top_clients_birthdays.txt', 2, 0, null, repeat('-', 50)))"""
CENTS = "cast(cast(round(cast({} as decimal(18,6)), 2) as decimal(18,2)) as varchar)"


@query(f"""with {AROUND}, q4 as (select 'c' || (store_id % 3) client_id, store_name, birthdate from (with {TB}, {FB}, {CNT} {_clients(_best('rank', tie=''))})),
b as (
    select 'c' || (store_id % 3) client_id, 'amount_filter_transactions.txt' file, row_number() over (order by transaction_id) place, transaction_id || ' - ' || {CENTS.format('final_amount')} line from ({Q1_SQL})
    union all select 'c' || (item_id % 2), 'top_items_by_quantity.txt', row_number() over (order by year_month_created_at, sellings_qty desc, item_id), year_month_created_at || ' - ' || item_name || ' - ' || sellings_qty from ({_items('sellings_qty', 3)})
    union all select 'c' || (item_id % 2), 'top_items_by_profit.txt', row_number() over (order by year_month_created_at, profit_sum desc, item_id), year_month_created_at || ' - ' || item_name || ' - ' || {CENTS.format('profit_sum')} from ({_items('profit_sum', 3)})
    union all select 'c' || (store_id % 3), 'tpv_summary.txt', row_number() over (order by year_half_created_at, store_name, store_id), 'Sucursal ' || store_id || ' ' || year_half_created_at || ' ' || store_name || ': $' || {CENTS.format('tpv')} from ({Q3_SQL})
    union all select client_id, 'top_clients_birthdays.txt', row_number() over (order by store_name, birthdate), store_name || ' - ' || birthdate from (select *, row_number() over (partition by client_id, store_name order by birthdate) r from q4) where r <= 3
), c as (select distinct client_id from b), h as (select distinct client_id, file, true there from b),
l as (
    select client_id, file, 1 block, place, line from b
    union all select c.client_id, a.file, block, place, line from c cross join a left join h on h.client_id = c.client_id and h.file = a.file where wants is null or wants = (there is not null)
) select client_id, file, row_number() over (partition by client_id, file order by block, place) n, line from l""")
def snk_files(s, d):
    """All five result files of three clients, written in order and read back line by line; one has no best items."""
    folder = J.fresh_folder(s, "results")
    of = lambda df, column, k: df.withColumn("client_id", F.concat(F.lit("c"), F.pmod(column, F.lit(k)).cast("string")))
    three = replace(D.ORDERS, top_items=3)
    S.write_results({
        S.AMOUNT: of(q1_amount_filter(s, d), "store_id", 3), S.TPV: of(q3_tpv(s, d), "store_id", 3), S.CLIENTS: of(q4_ties_rank(s, d), "store_id", 3),
        S.BY_QUANTITY: of(Q.top_items(D.items(s, d), D.menu(s, d), "sellings_qty", three), "item_id", 2), S.BY_PROFIT: of(Q.top_items(D.items(s, d), D.menu(s, d), "profit_sum", three), "item_id", 2),
    }, folder)
    return read_lines(s, folder)


@query(f"select year_month_created_at || ' - ' || item_name || ' - ' || {CENTS.format('profit_sum')} line from ({_items('profit_sum')})")
def snk_lines_q2_profit(s, d):
    return S.lines_items(q2_top_profit(s, d), "profit_sum")


def _item_text(s, d):
    """Items as one JSON message for each order, of which three in forty can't be read, and some rows of others."""
    item = F.struct(F.col("transaction_id").cast("string").alias("transaction_id"), F.when(F.pmod("item_id", F.lit(40)) == 7, "no number").otherwise(F.col("item_id").cast("string")).alias("item_id"), F.col("quantity").cast("string").alias("quantity"), F.lit("1.0").alias("unit_price"), F.col("subtotal").cast("string").alias("subtotal"))
    # In order: rows come to a task in none, and a message is to have the same text whenever it is made.
    sent = D.items(s, d).groupBy("transaction_id").agg(F.sort_array(F.collect_list(item)).alias("data"))
    value = F.to_json(F.struct(F.lit("c1").alias("client_id"), F.col("transaction_id").cast("string").alias("message_uuid"), "data"))
    at = lambda k: F.pmod("transaction_id", F.lit(40)) == k
    return sent.select("transaction_id", F.when(at(3), F.concat(F.lit("{"), value)).when(at(5), "").when(at(9), F.regexp_replace(value, '"data":', '"rows":')).otherwise(value).alias("value"))


def _messages_in_two_runs(s, d):
    """Messages as text files, read as a stream that stops after the first half and goes on where it stopped."""
    folder = J.fresh_folder(s, "messages")
    # Put down once: were it made anew for each half, a message could fall into both or none.
    _item_text(s, d).withColumn("half", F.pmod(F.xxhash64("transaction_id"), F.lit(2))).select("half", "value").write.parquet(f"{folder}/made")
    text = s.read.parquet(f"{folder}/made")
    stream = lambda: J.file_stream(s, f"{folder}/in", "value string", "text", files=2)
    for half in (0, 1):
        text.where(F.col("half") == half).select("value").repartition(3).write.mode("append").text(f"{folder}/in")
        J.run_messages(stream(), folder, "transaction_items")
    return folder


MESSAGES = f"with {IT} select *, transaction_id % 40 kind from it"


@query(f"select cast(transaction_id as varchar) transaction_id, cast(item_id as integer) item_id, cast(quantity as integer) quantity, subtotal, 'c1' client_id, cast(transaction_id as varchar) message_uuid from ({MESSAGES}) where kind not in (3, 5, 9) and item_id % 40 <> 7")
def stream_messages(s, d):
    """What a stream of messages gives, over a restart."""
    return s.read.parquet(f"{_messages_in_two_runs(s, d)}/rows").select("transaction_id", "item_id", "quantity", "subtotal", "client_id", "message_uuid")


@query(f"""select null::varchar client_id, null::varchar message_uuid, case kind when 3 then 'not JSON' else 'empty text' end reason, 1 n from (select distinct transaction_id, kind from ({MESSAGES})) where kind in (3, 5)
union all select distinct 'c1', cast(transaction_id as varchar), 'no rows', 1 from ({MESSAGES}) where kind = 9
union all select 'c1', cast(transaction_id as varchar), 'item_id: not a int', count(*) from ({MESSAGES}) where kind not in (3, 5, 9) and item_id % 40 = 7 group by transaction_id""")
def stream_dead_letters(s, d):
    """What a stream of messages could not read, and why, over a restart: messages, and rows of good ones."""
    dead = s.read.parquet(f"{_messages_in_two_runs(s, d)}/dead")
    dead = dead.withColumn("one", F.when(F.col("client_id").isNull(), F.monotonically_increasing_id()))  # unread messages have nothing that tells them apart
    known = F.when(F.col("reason") != "not JSON", F.struct("client_id", "message_uuid"))
    return dead.groupBy(known["client_id"].alias("client_id"), known["message_uuid"].alias("message_uuid"), "reason", "one").agg(F.count(F.lit(1)).cast("int").alias("n")).drop("one")


@query(f"with {IT}, {TOT} select * from tot")
def agg_incremental(s, d):
    """Totals refreshed over two deliveries: files by year, of which the second replaces two."""
    folder = J.fresh_folder(s, "rollup")
    rows = D.items(s, d).withColumn("y", F.year("created_at"))

    def deliver(df):
        df.hint("rebalance", "y").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("y").parquet(f"{folder}/source")
        U.refresh(s, f"{folder}/source", f"{folder}/kept", partial)

    def partial(df):
        df = df.where(L.year_in("created_at", D.ORDERS.years))
        return df.groupBy("file", C.year_month("created_at").alias("year_month_created_at"), "item_id").agg(F.sum("quantity").alias("sellings_qty"), A.money_sum("subtotal").alias("profit_sum"))

    deliver(rows.withColumn("quantity", F.when(F.col("y").isin(1996, 1997), F.col("quantity") * 3).otherwise(F.col("quantity"))))
    deliver(rows.where("y in (1996, 1997)"))
    sums = U.totals(s, f"{folder}/kept", ["year_month_created_at", "item_id"], ["sellings_qty", "profit_sum"])
    return sums.withColumn("profit_sum", F.col("profit_sum").cast("double"))


def _named_twice(s, d):
    """Stores with their old names, and all but one with new ones."""
    nation = D.table(s, d, "nation").select(F.lit("c").alias("client_id"), F.col("n_nationkey").cast("string").alias("key"), "n_name")
    return nation.select("client_id", "key", F.concat(F.lit("old "), "n_name").alias("name"), F.lit(1).cast("long").alias("seq")), nation.select("client_id", "key", F.col("n_name").alias("name"), F.lit(2).cast("long").alias("seq")).where("key <> '7'")


@query(f"with {TB} select transaction_id, store_id, case store_id when 7 then 'old NATION_7' else coalesce(n_name, 'Unknown Store') end store_name from tb left join nation on store_id = n_nationkey")
def stream_named(s, d):
    """Events before, between and after the files of their stores, which wait until the stores' end was said."""
    folder = J.fresh_folder(s, "named")
    old, new = _named_twice(s, d)
    events = D.event_transactions(s, d).select(F.lit("c").alias("client_id"), "transaction_id", "store_id")
    ends = s.range(1).select(F.lit("c").alias("client_id"))
    third = lambda k: events.where(F.pmod("transaction_id", F.lit(3)) == k)
    for name, df in (("facts", events), ("stores", old), ("ends", ends)):
        df.where("false").write.parquet(f"{folder}/{name}")

    def run():
        read = lambda name, df: J.file_stream(s, f"{folder}/{name}", df.schema, size=BATCH)
        J.run_available(K.named(read("facts", events), read("stores", old), read("ends", ends), "store_id", "store_name", "Unknown Store"), folder)

    for k, parts in enumerate(([("facts", third(0)), ("stores", old)], [("facts", third(1)), ("stores", new)], [("ends", ends)], [("facts", third(2))])):
        for name, df in parts:
            df.write.mode("append").parquet(f"{folder}/{name}")
        run()
    return s.read.parquet(f"{folder}/out").select("transaction_id", "store_id", "store_name")


@query(f"with {TB} select transaction_id, cast(store_id as varchar) client_id from tb where store_id % 3 = 0")
def stream_gate(s, d):
    """Rows of clients whose stores and users both came to their end, held until then."""
    folder = J.fresh_folder(s, "gate")
    rows = _events(_stream(s, d, "events")).select("transaction_id", F.col("store_id").cast("string").alias("client_id"))
    clients = D.event_transactions(s, d).select("store_id").distinct()
    came = F.when(F.pmod("store_id", F.lit(3)) == 0, F.array(F.lit("stores"), F.lit("users"))).otherwise(F.array(F.lit("stores"), F.lit("stores")))
    ends = clients.select(F.col("store_id").cast("string").alias("client_id"), F.explode(came).alias("input"))
    ends.where("input = 'stores'").write.parquet(f"{folder}/ends")
    run = lambda: J.run_available(K.gated(rows, J.file_stream(s, f"{folder}/ends", ends.schema), ["stores", "users"], parts=8), folder)
    run()
    ends.where("input = 'users'").write.mode("append").parquet(f"{folder}/ends")
    run()
    return s.read.parquet(f"{folder}/out").select("transaction_id", "client_id")


@query(f"with {TA} select transaction_id, store_id, case when store_id % 2 = 0 then 'new ' else '' end || n_name store_name from ta left join nation on store_id = n_nationkey")
def join_kept(s, d):
    """Stores kept as a bucketed table, of which a second delivery renames half."""
    kept = KeptDimension(s, f"stores_{uuid.uuid4().hex}", J.fresh_folder(s, "kept"))
    nation = D.table(s, d, "nation")
    kept.deliver(nation, "n_nationkey", "n_name", F.lit(1))
    kept.deliver(nation.where("n_nationkey % 2 = 0").withColumn("n_name", F.concat(F.lit("new "), "n_name")), "n_nationkey", "n_name", F.lit(2))
    return kept.lookup(D.order_transactions(s, d).select("transaction_id", "store_id"), "store_id", "store_name", "Unknown Store")


@query(f"with {TB} select transaction_id, store_id, final_amount from tb")
def stream_admission(s, d):
    """Events from many files, admitted by size, of which files done go to an archive; two runs."""
    folder = J.fresh_folder(s, "admission")
    events = D.event_transactions(s, d).select("transaction_id", "store_id", "final_amount")
    for k in (0, 1):
        events.where(F.pmod("transaction_id", F.lit(2)) == k).repartition(6).write.mode("append").parquet(f"{folder}/in")
        stream = J.file_stream(s, f"{folder}/in", events.schema, size=100_000, archive=f"{folder}/done")
        J.run_available(stream, folder)
    return s.read.parquet(f"{folder}/out").select("transaction_id", "store_id", "final_amount")


def _written(s, df, entity):
    """df as CSV files of an entity, in a new folder; blanks stay."""
    folder = J.fresh_folder(s, "csv")
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{entity}")
    return folder


def _user_text(s, d):
    born = F.date_add(F.lit("1960-01-01").cast("date"), F.pmod(F.col("c_custkey") * 13, F.lit(16000)).cast("int")).cast("string")
    key, at = F.col("c_custkey"), lambda k: F.pmod("c_custkey", F.lit(20)) == k
    return D.table(s, d, "customer").select(
        F.when(at(3), F.concat(F.lit("u"), key.cast("string"))).when(at(4), F.concat(key.cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), key.cast("string"))).alias("user_id"), F.lit("f ").alias("gender"),
        F.when(at(5), "1960-13-40").otherwise(born).alias("birthdate"), F.when(at(6), "long ago").otherwise("2023-07-01 08:00:00").alias("registered_at"),
    )


@query(f"select c_custkey user_id, 'f' gender, case when c_custkey % 20 <> 5 then cast({BORN} as date) end birthdate, case when c_custkey % 20 <> 6 then timestamp '2023-07-01 08:00:00' end registered_at from customer where c_custkey % 20 <> 3")
def src_users(s, d):
    """Customers as CSV, read back typed: ids with a fraction of 0 are read, dates that are none are null, ids that are no number are rejects."""
    return I.typed(I.read_csv(s, _written(s, _user_text(s, d), "users"), "users"), "users")[0]


@query("select cast(n_nationkey as integer) store_id, n_name store_name from nation")
def src_stores(s, d):
    """Stores as CSV with columns that are not taken, read back typed."""
    text = D.table(s, d, "nation").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias(" store_id"), F.concat("n_name", F.lit(" ")).alias("store_name "), F.lit("a street, 1").alias("street"), F.col("n_regionkey").alias("city"))
    return I.typed(I.read_csv(s, _written(s, text, "stores"), "stores"), "stores")[0].select("store_id", "store_name")


@query("select cast(p_partkey as integer) item_id, p_name item_name, p_type category, case when p_partkey % 10 = 0 then 0.0 else cast(cast(p_retailprice as decimal(18,6)) as double) end price, 'True' is_seasonal, '2024-01-01' available_from, null::varchar available_to from part where p_partkey % 10 <> 1")
def src_menu(s, d):
    """Items as CSV, read back typed: an empty price is 0, one that is no number makes a reject."""
    at = lambda k: F.pmod("p_partkey", F.lit(10)) == k
    text = D.table(s, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("category"), F.when(at(0), "").when(at(1), "free").otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.lit("True").alias("is_seasonal"), F.lit("2024-01-01").alias("available_from"), F.lit(None).cast("string").alias("available_to"),
    )
    return I.typed(I.read_csv(s, _written(s, text, "menu_items"), "menu_items"), "menu_items")[0]


REJECTS = "from orders where o_orderkey % 30 in (1, 2, 3)"


@query(f"""select cast(o_orderkey as varchar) transaction_id, case o_orderkey % 30 when 1 then 'store_id: not a int' when 2 then 'final_amount: not a double' else 'store_id: not a int; user_id: not a bigint; final_amount: not a double' end failed {REJECTS}
union all select 'all', count(*) || ' rows, ' || count(case when o_orderkey % 30 in (1, 3) then 1 end) || ' stores, ' || count(case when o_orderkey % 30 in (2, 3) then 1 end) || ' amounts' from orders""")
def src_rejects(s, d):
    """Rejected transactions with the rules that they fail, and the counts of two rules, observed as the rows pass by."""
    at = lambda *k: F.pmod("o_orderkey", F.lit(30)).isin(*k)
    text = D.table(s, d, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.when(at(1, 3), "-4").otherwise("4").alias("store_id"), F.lit("1").alias("payment_method_id"), F.lit("").alias("voucher_id"), F.when(at(3), "someone").otherwise("7").alias("user_id"),
        F.lit("").alias("original_amount"), F.lit("").alias("discount_applied"), F.when(at(2, 3), "12,5").otherwise("12.5").alias("final_amount"), F.lit("2024-01-01 10:00:00").alias("created_at"),
    )
    seen = Observation()
    rows = I.judged(I.read_csv(s, _written(s, text, "transactions"), "transactions"), "transactions", seen)
    folder = J.fresh_folder(s, "rejects")
    rows.select(F.col("transaction_id"), F.array_join("_failed", "; ").alias("failed")).write.parquet(folder)
    counts = I.failures(seen, "transactions")
    said = f"{counts['rows']} rows, {counts['store_id: not a int']} stores, {counts['final_amount: not a double']} amounts"
    return s.read.parquet(folder).where("failed <> ''").unionByName(s.range(1).select(F.lit("all").alias("transaction_id"), F.lit(said).alias("failed")))


@query(f"select c_custkey user_id, case when c_custkey % 20 <> 5 then cast({BORN} as date) end birthdate from customer where c_custkey % 20 <> 3 union all select null, cast({BORN} as date) from customer where c_custkey % 20 = 3")
def src_checking(s, d):
    """Users as a check of results reads them: no row is left out, dates that are none are null."""
    return I.checking_scan(s, _written(s, _user_text(s, d), "users"), "users").select("user_id", "birthdate")


@query(f"with {TA} select transaction_id, final_amount from ta where year(created_at) in (1996, 1998) and cast(created_at as time) between time '08:00:00' and time '20:00:00' and final_amount >= 200000")
def q1_thresholds(s, d):
    """Q1 with thresholds from variables of the environment."""
    config = QueryConfig.from_environment({"MIN_YEAR": "1996", "MAX_YEAR": "1998", "START_HOUR": "8", "END_HOUR": "20", "MIN_AMOUNT": "200000"})
    return Q.amount_filter(D.order_transactions(s, d), config).select("transaction_id", "final_amount")


@query("""select event_id, strftime(ts, '%H:%M:%S') time_of_day, case event_id % 5 when 0 then false when 1 then false when 2 then false when 3 then true else value > 0 end positive from events""")
def fn_time_positive(s, d):
    """Time of day of text, and whether text is a number above 0."""
    at = lambda k: F.pmod("event_id", F.lit(5)) == k
    text = F.when(at(0), "-1.5").when(at(1), "none").when(at(2), F.lit(None)).when(at(3), " 0.01 ").otherwise(F.col("value").cast("string"))
    return D.table(s, d, "events").select("event_id", C.time_text(C.strict_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("time_of_day"), C.is_positive(text).alias("positive"))


@query("select user_id % 50 as k, count(*) n from events where event_type <> 'error' group by all")
def flt_null_user(s, d):
    """Purchases by user, those of nobody left out."""
    rows = D.table(s, d, "events").select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"))
    return L.has_key(rows, "user_id").groupBy(F.pmod("user_id", F.lit(50)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select store_name, tpv, null::varchar birthdate from ({Q3_SQL})")
def val_aligned(s, d):
    """Results brought to the columns that a check expects."""
    return V.aligned(q3_tpv(s, d), ["store_name", "tpv", "birthdate"])


class Spread(A.Accumulator):
    """Count, sum and sum of squares of whole cents, which give the mean and the deviation exactly to the last step."""

    def init(self):
        return (0, 0, 0)

    def add(self, state, rows):
        cents = [round(100 * v) for v in rows["value"] if v is not None and v == v]
        return self.merge(state, (len(cents), sum(cents), sum(c * c for c in cents)))

    def merge(self, a, b):
        return tuple(x + y for x, y in zip(a, b))

    def finish(self, state):
        n, total, squares = state
        return n, total / n / 100, ((n * squares - total * total) / (n * n)) ** 0.5 / 100


@query("select event_type, n, total / n / 100 as mean, round(sqrt((n * squares - total * total) / (n * n)) / 100, 6) as deviation from (select event_type, count(*) n, cast(sum(c) as double) total, cast(sum(c * c) as double) squares from (select event_type, cast(round(value * 100) as bigint) c from events) group by event_type)")
def agg_own(s, d):
    """A caller's own accumulator over events by type."""
    return A.accumulate_with(D.table(s, d, "events"), ["event_type"], ["value"], Spread(), "n long, mean double, deviation double").withColumn("deviation", F.round("deviation", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
