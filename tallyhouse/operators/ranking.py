"""Best of each group, and the orders of results. Ties always end in a key, so a result does not depend on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions import columns as C

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def top_n(df: DataFrame, per: list[str], by: str, n: int, ties: str = "row_number", then: list[str | Column] = ()) -> DataFrame:
    """Rows of the n greatest by in each group. ties: row_number takes n rows, ordered on by `then`; rank keeps all rows
    equal to the n-th; dense_rank all rows with one of the n greatest values."""
    order = [F.desc(by), *(then if ties == "row_number" else ())]
    return df.withColumn("_rank", RANKS[ties]().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def order_in(per: list[str], by: str, then: list[str | Column]):
    """The window in which a group's greatest by comes first."""
    return Window.partitionBy(*per).orderBy(F.desc(by), *then)


def cap_by_name(df: DataFrame, name: str = "store_name", order: str = "birthdate", n: int = 3) -> DataFrame:
    """At most n rows of one displayed name, whatever ids share it; equal rows all count."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(name).orderBy(order))).where(F.col("_nth") <= n).drop("_nth")


def order_tpv(df: DataFrame) -> DataFrame:
    half = C.normalized_half("year_half_created_at")
    return df.orderBy(half["year"], half["semester"], "store_name", *C.id_order("store_id"))


def order_items(df: DataFrame, metric: str) -> DataFrame:
    month = C.normalized_month("year_month_created_at")
    return df.orderBy(month["year"], month["month"], F.desc(metric), *C.id_order("item_id"))


def order_clients(df: DataFrame) -> DataFrame:
    return df.orderBy("store_name", "birthdate", "user_id")
