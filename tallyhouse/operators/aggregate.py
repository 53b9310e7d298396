"""Sums and counts of the business questions. Money is summed as decimals, so that the order of rows does not matter."""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyhouse.functions import columns as C


def by_client(df: DataFrame) -> list[str]:
    return ["client_id"] if "client_id" in df.columns else []


def money_sum(c: str):
    return F.sum(C.as_decimal(c))


def payment_value(df: DataFrame) -> DataFrame:
    """sum(final_amount) as decimal tpv by half-year and store, from created_at as a moment; rows without one are left out."""
    rows = df.select(*by_client(df), C.year_half("created_at").alias("year_half_created_at"), "store_id", C.double_of(df, "final_amount").alias("final_amount"))
    return rows.where("year_half_created_at is not null and store_id is not null").groupBy(*by_client(df), "year_half_created_at", "store_id").agg(money_sum("final_amount").alias("tpv"))


def item_totals(df: DataFrame, month=None) -> DataFrame:
    """sellings_qty and decimal profit_sum by month and item, in one pass."""
    month = C.year_month("created_at") if month is None else month
    rows = df.select(*by_client(df), month.alias("year_month_created_at"), "item_id", C.long_of(df, "quantity").alias("quantity"), C.double_of(df, "subtotal").alias("subtotal"))
    rows = rows.where("year_month_created_at is not null and item_id is not null")
    return rows.groupBy(*by_client(df), "year_month_created_at", "item_id").agg(F.sum("quantity").alias("sellings_qty"), money_sum("subtotal").alias("profit_sum"))


def purchase_counts(df: DataFrame) -> DataFrame:
    """purchases_qty by store and user; users that can't be read or are negative count as 0, anonymous."""
    user = C.long_of(df, "user_id")
    rows = df.where("store_id is not null").select(*by_client(df), "store_id", F.greatest(user, F.lit(0).cast("long")).alias("user_id"))
    return rows.groupBy(*by_client(df), "store_id", "user_id").agg(F.count(F.lit(1)).alias("purchases_qty"))


def sums(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """sum(value) by keys, as decimal; a null key is a group of its own, as checks of results count it."""
    return df.select(*keys, C.double_of(df, value).alias(value)).groupBy(*keys).agg(money_sum(value).alias(name))


def accumulate(df: DataFrame, keys: list[str], aggregates: dict[str, str | Column]) -> DataFrame:
    """The caller's aggregates by keys: name to an aggregate column, or its SQL; rows with a null key are left out."""
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else df
    return known.groupBy(*keys).agg(*[(F.expr(a) if isinstance(a, str) else a).alias(n) for n, a in aggregates.items()])


class Accumulator:
    """A caller's own aggregate. State is what pickle can carry, and stays small: it is sent once a batch and group.

    init() gives a fresh state; add(state, rows) takes a pandas DataFrame of some rows of one group; merge(a, b) unites
    two states, in any order; finish(state) gives the values of the output's columns.
    """

    def init(self):
        raise NotImplementedError

    def add(self, state, rows):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def finish(self, state) -> tuple:
        raise NotImplementedError


def accumulate_with(df: DataFrame, keys: list[str], values: list[str], accumulator: Accumulator, schema: str, fan: int = 32) -> DataFrame:
    """keys and the columns of schema: the accumulator over each group; rows with a null key are left out.

    States are made where rows are, one for each group and Arrow batch, merged in `fan` parts of a group and then over
    its parts. Tasks meet states, never a group's rows, so a hot key needs no task of its own.
    """
    names = [f.name for f in df.select(*keys).schema]
    base = df.select(*keys).schema

    def partial(batches):
        import pyarrow as pa

        for n, b in enumerate(batches):
            groups = b.to_pandas().groupby(names, sort=False)
            rows = [(k if isinstance(k, tuple) else (k,), pickle.dumps(accumulator.add(accumulator.init(), g[values]))) for k, g in groups]
            if rows:
                columns = [pa.array([k[i] for k, _ in rows], b.schema.field(names[i]).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n % fan] * len(rows), pa.int32()), pa.array([s for _, s in rows], pa.binary())], [*names, "_part", "_state"])

    def united(table):
        state = None
        for s in table.column("_state"):
            s = pickle.loads(s.as_py())
            state = s if state is None else accumulator.merge(state, s)
        return state

    def merged(table):
        import pyarrow as pa

        return table.slice(0, 1).drop_columns(["_state"]).append_column("_state", pa.array([pickle.dumps(united(table))], pa.binary()))

    def finished(table):
        import pyarrow as pa

        out = pa.Table.from_pylist([dict(zip(result.fieldNames(), accumulator.finish(united(table))))], to_arrow_schema(result))
        for name in reversed(names):
            out = out.add_column(0, name, table.slice(0, 1).column(name))
        return out

    result = StructType.fromDDL(schema)
    state = StructType([*base.fields]).add("_part", "integer").add("_state", "binary")
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, *values)
    parts = known.mapInArrow(partial, state)
    spread = parts.withColumn("_part", F.pmod(F.spark_partition_id() + F.col("_part"), F.lit(fan)).cast("int"))
    some = spread.groupBy(*keys, "_part").applyInArrow(merged, state)
    return some.groupBy(*keys).applyInArrow(finished, StructType([*base.fields, *result.fields]))


def merge_partials(partials: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Totals of stored partial totals, as of a file or a day."""
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def merge_nested(df: DataFrame, column: str, name: str) -> DataFrame:
    """Totals by month and item of map<month, map<item, number>> bundles; what is no number is left out."""
    by_month = df.select(*by_client(df), F.explode(column).alias("year_month_created_at", "_items"))
    rows = by_month.select(*by_client(df), "year_month_created_at", F.explode("_items").alias("item_id", "_n"))
    rows = rows.select(*by_client(df), "year_month_created_at", F.col("item_id").cast("string").try_cast("int").alias("item_id"), F.col("_n").cast("string").try_cast("decimal(18,6)").alias("_n"))
    return rows.where("item_id is not null and _n is not null").groupBy(*by_client(df), "year_month_created_at", "item_id").agg(F.sum("_n").alias(name))
