"""Result sets: one tagged stream of rows, text lines, JSON envelopes, completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions import columns as C
from tallyhouse.operators import ranking as R
from tallyhouse.sinks.result_files import write_lines

#: Names of the result types.
AMOUNT, BY_QUANTITY, BY_PROFIT, TPV, CLIENTS = "AMOUNT_FILTER_TRANSACTIONS", "TOP_ITEMS_BY_QUANTITY", "TOP_ITEMS_BY_PROFIT", "TPV_SUMMARY", "TOP_CLIENTS_BIRTHDAYS"
TYPES = (AMOUNT, BY_QUANTITY, BY_PROFIT, TPV, CLIENTS)


#: Result files and the lines between the rules of their headers.
FILES = {
    AMOUNT: ("amount_filter_transactions.txt", ("Transacciones (Id y monto) realizadas durante 2024 y 2025", "entre las 06:00 AM y las 11:00 PM con monto total >= $75")),
    BY_QUANTITY: ("top_items_by_quantity.txt", ("TOP ÍTEMS POR CANTIDAD (2024-2025, 06:00-23:00)",)),
    BY_PROFIT: ("top_items_by_profit.txt", ("TOP ÍTEMS POR GANANCIA (2024-2025, 06:00-23:00)",)),
    TPV: ("tpv_summary.txt", ("RESUMEN TPV POR SEMESTRE Y SUCURSAL (2024-2025)", "Transacciones entre las 06:00 y las 23:00")),
    CLIENTS: ("top_clients_birthdays.txt", ("Cumpleaños de los clientes con más compras por sucursal (2024-2025)",)),
}


RULE, LINE = "=" * 60, "-" * 50
NO_ROWS = "Sin registros que cumplan las condiciones."
#: What stands in a result file before its rows, in their place where there are none, and after them.
BODIES = {
    AMOUNT: ((), (), ()),
    BY_QUANTITY: (("year_month_created_at - item_name - sellings_qty",), (NO_ROWS,), (LINE,)),
    BY_PROFIT: (("year_month_created_at - item_name - profit_sum",), (NO_ROWS,), (LINE,)),
    TPV: ((), ("Sin registros que cumplan las condiciones para calcular TPV.",), (LINE,)),
    CLIENTS: (("TOP CLIENTES POR SUCURSAL (2024-2025)", "store_name - birthdate"), ("TOP CLIENTES POR SUCURSAL (2024-2025)", NO_ROWS), (LINE,)),
}


def tagged(results: dict[str, DataFrame]) -> DataFrame:
    """All rows of the result sets, with result_type; columns that a set lacks are null."""
    parts = [df.select(F.lit(kind).alias("result_type"), "*") for kind, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def classified(df: DataFrame) -> DataFrame:
    """Untyped rows with the result_type that the columns with values show, the first that fits; null if none does."""
    has = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    month = has("year_month_created_at")
    kind = (
        F.when(has("transaction_id") | has("final_amount"), AMOUNT).when(month & has("sellings_qty"), BY_QUANTITY).when(month & has("profit_sum"), BY_PROFIT)
        .when(has("tpv") | has("year") | has("semester") | has("store_name"), TPV).when(has("user_id") & has("purchases_qty") | has("birthdate"), CLIENTS)
    )
    return df.withColumn("result_type", kind)


def lines_amount(df: DataFrame) -> DataFrame:
    return df.select(*_client(df), F.concat_ws(" - ", F.col("transaction_id").cast("string"), C.money(C.double_of(df, "final_amount"))).alias("line"))


def lines_items(df: DataFrame, metric: str) -> DataFrame:
    """month - name - value; without clients, a single line that says so where there are no rows. See result_lines() for clients."""
    value = F.col(metric).cast("bigint").cast("string") if metric == "sellings_qty" else C.money(metric)
    lines = df.select(*_client(df), F.concat_ws(" - ", "year_month_created_at", "item_name", value).alias("line"))
    if "client_id" in df.columns:
        return lines
    none = df.sparkSession.range(1).select(F.lit(NO_ROWS).alias("line"))
    return lines.unionByName(none.join(lines.limit(1).select(F.lit(1).alias("_some")), F.lit(True), "left_anti"))


def lines_tpv(df: DataFrame) -> DataFrame:
    return df.select(*_client(df), _tpv_line(df).alias("line"))


def _tpv_line(df: DataFrame) -> Column:
    parts = [F.col(c).cast("string") for c in ("year", "semester") if c in df.columns]
    period = F.coalesce(F.nullif(F.col("year_half_created_at"), F.lit("")), F.concat_ws(" ", *parts))
    return F.concat(F.lit("Sucursal "), F.col("store_id").cast("string"), F.lit(" "), period, F.lit(" "), "store_name", F.lit(": $"), C.money("tpv"))


def lines_clients(df: DataFrame, n: int = 3) -> DataFrame:
    """name - birthdate, at most n lines of one store name (of each client)."""
    named = df.withColumn("_name", F.concat_ws("\x00", *_client(df), "store_name"))
    return R.cap_by_name(named, "_name", "birthdate", n).select(*_client(df), F.concat_ws(" - ", "store_name", "birthdate").alias("line"))


def _client(df: DataFrame) -> list[str]:
    return ["client_id"] if "client_id" in df.columns else []


#: Columns that order a file's lines; each result fills those that its own order has.
ORDER = {"block": "int", "o_year": "int", "o_part": "int", "o_value": "double", "o_name": "string", "o_text": "string", "o_number": "bigint", "o_id": "string"}


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns of ORDER, as ranking.order_tpv, order_items and order_clients order rows; amounts by transaction."""
    if kind in (BY_QUANTITY, BY_PROFIT):
        month, number = C.normalized_month("year_month_created_at"), C.id_order("item_id")
        own = {"o_year": month["year"], "o_part": month["month"], "o_value": -F.col("sellings_qty" if kind == BY_QUANTITY else "profit_sum").cast("double"), "o_number": number[0], "o_id": number[1]}
    elif kind == TPV:
        half, number = C.normalized_half("year_half_created_at"), C.id_order("store_id")
        own = {"o_year": half["year"], "o_part": half["semester"], "o_name": F.col("store_name"), "o_number": number[0], "o_id": number[1]}
    elif kind == CLIENTS:
        own = {"o_name": F.col("store_name"), "o_text": F.col("birthdate").cast("string")}
    else:
        number = C.id_order("transaction_id")
        own = {"o_number": number[0], "o_id": number[1]}
    return df.withColumns({c: own.get(c, F.lit(1 if c == "block" else None)).cast(t) for c, t in ORDER.items()})


def _lines(df: DataFrame, kind: str) -> DataFrame:
    """(client_id, ORDER, line) of a result's rows."""
    if kind == CLIENTS:
        capped = df.withColumn("_name", F.concat_ws("\x00", F.coalesce(F.concat(F.lit("c"), "client_id"), F.lit("")), "store_name"))
        df = R.cap_by_name(capped, "_name", "birthdate", 3).drop("_name")
    df = ordered(df, kind)
    carried = ["client_id", *ORDER]
    if kind == AMOUNT:
        line = F.concat_ws(" - ", F.col("transaction_id").cast("string"), C.money(C.double_of(df, "final_amount")))
    elif kind == TPV:
        line = _tpv_line(df)
    elif kind == CLIENTS:
        line = F.concat_ws(" - ", "store_name", F.coalesce(F.col("birthdate").cast("string"), F.lit("")))
    else:
        line = F.concat_ws(" - ", "year_month_created_at", "item_name", F.coalesce(F.col("sellings_qty").cast("bigint").cast("string"), F.lit("0")) if kind == BY_QUANTITY else C.money("profit_sum"))
    return df.select(*carried, line.alias("line"))


def result_lines(results: dict[str, DataFrame]) -> DataFrame:
    """(client_id, file, ORDER, line): all five files of every client that has rows in any of the results.

    results: rows with client_id by result type. A result without rows of a client says so in the client's file; a type
    that is missing has its header only.
    """
    body = reduce(DataFrame.unionByName, [_lines(df, kind).select("client_id", F.lit(kind).alias("kind"), *ORDER, "line") for kind, df in results.items()])
    there = body.groupBy("client_id", "kind").agg(F.lit(1).alias("n"))
    entry = lambda block, n, kind, line, rows: F.struct(F.lit(block).alias("block"), F.lit(n).alias("o_part"), F.lit(kind).alias("kind"), F.lit(line).alias("line"), F.lit(rows).alias("rows"))
    fixed = []
    for kind, (_, title) in FILES.items():
        fixed += [entry(-1, n, kind, line, None) for n, line in enumerate((RULE, *title, RULE, ""))]
        if kind in results:
            head, empty, end = BODIES[kind]
            fixed += [entry(0, n, kind, line, True) for n, line in enumerate(head)] + [entry(0, n, kind, line, False) for n, line in enumerate(empty)]
            fixed += [entry(2, n, kind, line, None) for n, line in enumerate(end)]
    around = there.select("client_id").distinct().select("client_id", F.explode(F.array(*fixed)).alias("f")).select("client_id", "f.*")
    has = there.select(F.col("client_id").alias("_client"), F.col("kind").alias("_kind"), "n")
    around = around.join(has, F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("kind") == F.col("_kind")), "left").where("rows is null or rows = (n is not null)")
    around = around.select("client_id", "kind", *[F.col(c) if c in ("block", "o_part") else F.lit(None).cast(t).alias(c) for c, t in ORDER.items()], "line")
    names = F.create_map(*[x for kind, (name, _) in FILES.items() for x in (F.lit(kind), F.lit(name))])
    return body.unionByName(around).withColumn("file", names[F.col("kind")]).drop("kind")


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """Writes result_lines() as text, in order; results of an earlier call are replaced. See sinks.result_files."""
    write_lines(result_lines(results), list(ORDER), path)


def envelopes(df: DataFrame, kind: str, size: int = 1000) -> DataFrame:
    """JSON lines {type, results, client_id} of at most `size` rows, each with its number in its client (part, from 0).

    A client's rows are dealt by their hash into groups of about 64 parts, so no task needs all of them. Numbers of
    parts may have gaps where there are several groups; a client of up to 64 x size rows has one group, without gaps.
    """
    names = [c for c in df.columns if c != "client_id"]
    client: Column = F.col("client_id").cast("string") if "client_id" in df.columns else F.lit(None).cast("string")
    rows = df.select(client.alias("client_id"), F.struct(*names).alias("row"))
    groups = rows.groupBy(F.col("client_id").alias("_client")).agg(F.ceil(F.count(F.lit(1)) / (64 * size)).alias("groups"))
    dealt = rows.join(groups, F.col("client_id").eqNullSafe(F.col("_client"))).withColumn("group", F.pmod(F.xxhash64(F.to_json("row")), "groups"))
    nth = F.row_number().over(Window.partitionBy("client_id", "group").orderBy("row"))
    part = F.col("group") + F.col("groups") * F.floor((nth - 1) / size)
    grouped = dealt.withColumn("part", part).groupBy("client_id", "part").agg(F.sort_array(F.collect_list("row")).alias("results"))
    return grouped.select("part", F.to_json(F.struct(F.lit(kind).alias("type"), "results", "client_id")).alias("value"))


def completion(df: DataFrame) -> DataFrame:
    """For each client: result types that came, and whether all are there."""
    seen = df.groupBy("client_id").agg(F.array_sort(F.collect_set("result_type")).alias("seen"))
    missing = F.size(F.array_except(F.array(*map(F.lit, TYPES)), "seen"))
    return seen.select("client_id", F.array_join("seen", ",").alias("seen"), (missing == 0).alias("complete"))


def gated(df: DataFrame, arrived: DataFrame, needed: list[str]) -> DataFrame:
    """Rows of clients for whom all needed inputs are complete. arrived: (client_id, input), in any number."""
    ready = arrived.where(F.col("input").isin(needed)).groupBy("client_id").agg(F.count_distinct("input").alias("_n")).where(F.col("_n") == len(set(needed)))
    return df.join(ready.select("client_id"), "client_id", "left_semi")
