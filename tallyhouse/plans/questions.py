"""The four questions: filter, aggregate, rank, and only then look names up, so that joins see few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.config import QueryConfig
from tallyhouse.functions import columns as C
from tallyhouse.operators import aggregate as A, filters as L, ranking as R
from tallyhouse.operators.dimensions import Dimension, lookup


def moment(df: DataFrame, strict: bool) -> DataFrame:
    """df with created_at as timestamp_ntz; text is read strictly, or in any ISO form."""
    if dict(df.dtypes)["created_at"] == "string":
        return df.withColumn("created_at", C.strict_timestamp("created_at") if strict else C.iso_timestamp("created_at"))
    return df


def first_of_each(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One row for each key and client; rows without a key all stay. Where a column seq tells arrival, the first row."""
    keys = [*A.by_client(df), key]
    known = df.where(F.col(key).isNotNull())
    if "seq" in df.columns:
        known = known.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), "seq").alias("_row")).select("_row.*")
    else:
        known = known.dropDuplicates(keys)
    return known.unionByName(df.where(F.col(key).isNull()))


def amount_filter(transactions: DataFrame, config: QueryConfig = QueryConfig(), dedup: bool = True) -> DataFrame:
    """Q1: transactions of the two years, within the hours, of at least the amount."""
    rows = moment(transactions, strict=True)
    rows = L.keep(rows, L.year_in("created_at", config.years), L.time_between("created_at", config.start, config.end), L.amount_at_least("final_amount", config.min_amount, C.is_number(rows, "final_amount")))
    return first_of_each(rows) if dedup else rows


def _totals(items: DataFrame, config: QueryConfig) -> DataFrame:
    month = None
    if dict(items.dtypes)["created_at"] == "string":
        month = C.year_month_text("created_at")
        items = items.where(L.year_in(C.iso_timestamp("created_at"), config.years))
    else:
        items = items.where(L.year_in("created_at", config.years))
    return A.item_totals(items, month)


def top_items(items: DataFrame, menu: Dimension, metric: str, config: QueryConfig = QueryConfig()) -> DataFrame:
    """Q2: the best items of each month by metric, sellings_qty or profit_sum. Items have no hours."""
    totals = _totals(items, config)
    best = R.top_n(totals, [*A.by_client(totals), "year_month_created_at"], metric, config.top_items, then=["item_id"])
    named = lookup(best, menu, "item_id", "item_name", few=True)
    return named.select(*A.by_client(totals), "year_month_created_at", "item_id", "item_name", F.col(metric).cast("double").alias(metric) if metric == "profit_sum" else metric)


def payment_value(transactions: DataFrame, stores: Dimension, config: QueryConfig = QueryConfig()) -> DataFrame:
    """Q3: total payment value by store and half-year."""
    rows = moment(transactions, strict=True)
    rows = L.keep(rows, L.year_in("created_at", config.years), L.time_between("created_at", config.start, config.end))
    totals = A.payment_value(rows)
    named = lookup(totals, stores, "store_id", "store_name")
    return named.select(*A.by_client(totals), "year_half_created_at", "store_id", "store_name", F.col("tpv").cast("double").alias("tpv"))


def normalized_payment_value(tpv: DataFrame) -> DataFrame:
    """Q3's rows with year, semester as H1 or H2, a trimmed name and the store's id as text."""
    half = C.normalized_half("year_half_created_at")
    return tpv.select(
        *A.by_client(tpv), half["text"].alias("year_half_created_at"), F.col("store_id").cast("string").alias("store_id"), F.trim("store_name").alias("store_name"),
        C.safe_double("tpv").alias("tpv"), half["year"].alias("year"), F.concat(F.lit("H"), half["semester"].cast("string")).alias("semester"),
    )


def top_clients(transactions: DataFrame, users: Dimension, stores: Dimension, config: QueryConfig = QueryConfig()) -> DataFrame:
    """Q4: the customers with most purchases of each store, with birthdates.

    Anonymous purchases take no place, unless config.compat_anonymous: then they are ranked and left out afterwards.
    """
    rows = moment(transactions, strict=False)
    rows = rows.where(L.year_in("created_at", config.years))
    counts = A.purchase_counts(rows)
    if not config.compat_anonymous:
        counts = counts.where("user_id > 0")
    best = R.top_n(counts, [*A.by_client(counts), "store_id"], "purchases_qty", config.top_users, config.ties, then=["user_id"]).where("user_id > 0")
    named = lookup(lookup(best, users, "user_id", "birthdate", few=True), stores, "store_id", "store_name")
    return named.select(*A.by_client(counts), "user_id", "store_id", "store_name", "birthdate", "purchases_qty")
