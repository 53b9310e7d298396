"""The given tables read as the model's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.config import QueryConfig
from tallyhouse.operators import filters as L
from tallyhouse.operators.dimensions import Dimension

ORDERS = QueryConfig(years=(1997, 1998), min_amount=250000.0)
EVENTS = QueryConfig(years=(2024, 2025), min_amount=75.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_transactions(spark: SparkSession, sf_dir: str, config: QueryConfig | None = None) -> DataFrame:
    """Orders with their customer's nation as the store, at a minute of the day that the order key gives.

    config: orders of its years alone, by a condition that the scan can use.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    if config is not None:
        orders = orders.where(L.year_in("o_orderdate", config.years))
    created = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.col("o_orderkey") * 37, F.lit(1440)).cast("int"))
    joined = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("transaction_id"), F.col("c_nationkey").cast("int").alias("store_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("final_amount"), created.alias("created_at")
    )


def event_transactions(spark: SparkSession, sf_dir: str, config: QueryConfig | None = None) -> DataFrame:
    """Events as purchases in 25 stores; errors are anonymous. config: events of its years alone, as for orders."""
    events = table(spark, sf_dir, "events")
    if config is not None:
        events = events.where(L.year_in("ts", config.years))
    return events.select(
        F.col("event_id").alias("transaction_id"), F.pmod("event_id", F.lit(25)).cast("int").alias("store_id"), F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.col("user_id")).cast("bigint").alias("user_id"),
        F.col("value").alias("final_amount"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("created_at"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_extendedprice").alias("subtotal"), F.col("l_shipdate").alias("created_at")
    )


def stores(spark: SparkSession, sf_dir: str) -> Dimension:
    return Dimension(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "Unknown Store")


def menu(spark: SparkSession, sf_dir: str) -> Dimension:
    return Dimension(table(spark, sf_dir, "part"), "p_partkey", "p_name", "Unknown Item")


def users(spark: SparkSession, sf_dir: str) -> Dimension:
    born = F.date_add(F.lit("1960-01-01").cast("date"), F.pmod(F.col("c_custkey") * 13, F.lit(16000)).cast("int")).cast("string")
    return Dimension(table(spark, sf_dir, "customer").select("c_custkey", born.alias("birthdate")), "c_custkey", "birthdate", "Unknown Birthday")
