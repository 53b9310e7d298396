"""Checks of results against expected ones, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.operators.ranking import top_n


def near(a: Column, b: Column, atol: float, rtol: float = 0.0) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Just these columns in this order; those that df lacks are null, as text."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def mismatches(actual: DataFrame, expected: DataFrame, keys: list[str], value: str | None = None, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """Keys found on one side only or a different number of times, and keys whose values lie apart.

    reason: missing, unexpected, count or value. The n-th least value of a key is held against the n-th; a null value
    is the least, and equal to null alone.
    """
    if value is None:
        group = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.lit(None).cast("double").alias("_value"), F.lit(1).alias("_nth"))
    else:
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_value"))
        group = lambda df: df.select(*keys, F.col(value).cast("double").alias("_value")).select("*", turn.alias("_nth"), F.lit(1).alias("_rows"))
    a = group(actual).select(*keys, "_nth", F.col("_rows").alias("_a"), F.col("_value").alias("_x"))
    e = group(expected).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_nth").alias("_n"), F.col("_rows").alias("_e"), F.col("_value").alias("_y"))
    on = F.col("_nth") == F.col("_n")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    present = F.col("_a").isNotNull()
    apart = present & F.col("_e").isNotNull() & ~F.coalesce(near(F.col("_x"), F.col("_y"), atol, rtol), F.col("_x").eqNullSafe(F.col("_y")))
    both = a.join(e, on, "full_outer").select(*[F.when(present, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], "_a", "_e", apart.alias("_apart"))
    seen = both.groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("_a"), F.coalesce(F.sum("_e"), F.lit(0)).alias("_e"), F.max("_apart").alias("_apart"))
    reason = F.when(F.col("_e") == 0, "unexpected").when(F.col("_a") == 0, "missing").when(F.col("_a") != F.col("_e"), "count").when(F.col("_apart"), "value")
    return seen.withColumn("reason", reason).where("reason is not null").select(*keys, "reason")


def outside_top(actual: DataFrame, counts: DataFrame, n: int = 3) -> DataFrame:
    """Rows of (store_id, user_id) that are not among their store's n best with ties."""
    allowed = top_n(counts.where("user_id > 0"), ["store_id"], "purchases_qty", n, ties="rank")
    return actual.join(allowed.select("store_id", "user_id"), ["store_id", "user_id"], "left_anti")


def sample(bad: DataFrame, n: int = 3, order: list[str | Column] | None = None) -> DataFrame:
    """The first n differences."""
    return bad.orderBy(*(order or bad.columns)).limit(n)


def first_keys(bad: DataFrame, keys: list[str], order: list[str | Column] | None = None, n: int = 3) -> DataFrame:
    """One row: the keys of the first n differences as text, in their order; empty text if there are none."""
    turn = Window.orderBy(*(order or keys))
    few = sample(bad, n, order or keys).withColumn("_nth", F.row_number().over(turn))  # n rows
    rows = F.sort_array(F.collect_list(F.struct("_nth", F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]).alias("text"))))
    return few.agg(F.array_join(F.transform(rows, lambda r: r["text"]), ", ").alias("first"))


#: Keys, value and tolerance of the checks of single questions.
CHECKS = {
    "Q1": (["transaction_id"], "final_amount", 0.01),
    "Q2a": (["year_month_created_at", "item_name"], "sellings_qty", 0.0),
    "Q2b": (["year_month_created_at", "item_name"], "profit_sum", 0.5),
    "Q3": (["year_half_created_at", "store_name"], "tpv", 0.5),
}


def full_report(actual: dict[str, DataFrame], expected: dict[str, DataFrame], n: int = 3) -> DataFrame:
    """label, ok, mismatches, size_difference, first of Q1, Q2a, Q2b, Q3 and Q4, those that actual has.

    Differences are met in the order of their keys. Q4 expects the set of all clients who may be given: each row must be
    one of them with the same birthdate, how many there are is free; its differences are in the order of store, most
    purchases, user and birthdate. first: the first n of them.
    """
    out = None
    for label, rows in actual.items():
        if label == "Q4":
            keys, order = ["store_id", "user_id", "birthdate"], ["store_id", F.desc("purchases_qty"), "user_id", "birthdate"]
            allowed = expected[label].select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
            bad, against = rows.join(allowed, on, "left_anti"), rows
        else:
            (keys, value, atol), order, against = CHECKS[label], None, expected[label]
            bad = mismatches(rows, against, keys, value, atol)
        row = report({label: (bad, rows, against)}).crossJoin(first_keys(bad, keys, order, n))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def report(checks: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """label, ok, mismatches, size_difference of {label: (mismatches, actual, expected)}."""
    out = None
    for label, (bad, actual, expected) in checks.items():
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        row = n(bad, "mismatches").crossJoin(n(actual, "_a")).crossJoin(n(expected, "_e"))  # one row each
        row = row.select(F.lit(label).alias("label"), (F.col("mismatches") == 0).alias("ok"), "mismatches", (F.col("_a") - F.col("_e")).alias("size_difference"))
        out = row if out is None else out.unionByName(row)
    return out
