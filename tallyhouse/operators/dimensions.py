"""Lookups of names in dimensions: never more rows than before, a default where nothing is found."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.operators.filters import usable_dimension


@dataclass(frozen=True)
class Dimension:
    """df's column value by its column key; of rows with one key, the last by order (then the greatest value) counts.

    order: columns of arrival, as seq. per: columns that, like client_id, belong to the key. No side is marked for
    broadcast: the planner does so by its size, with a sort-merge join beyond its threshold.
    """

    df: DataFrame
    key: str
    value: str
    default: str
    order: tuple[str, ...] = ()
    per: tuple[str, ...] = field(default_factory=tuple)

    def last_written(self, wanted: DataFrame | None = None) -> DataFrame:
        """_key and _value by key; with wanted, a table of _key, of these keys alone, so that no others are grouped."""
        rows = usable_dimension(self.df, self.key, self.value)
        if wanted is not None:
            rows = rows.join(wanted, F.col(self.key) == F.col("_key"), "left_semi")
        by = F.struct(*self.order, F.col(self.value)) if self.order else F.col(self.value)
        return rows.groupBy(*self.per, F.col(self.key).alias("_key")).agg(F.max_by(F.col(self.value), by).alias("_value"))


def lookup(df: DataFrame, dim: Dimension, key: str | Column, name: str, few: bool = False) -> DataFrame:
    """df with the dimension's value for key as column name. few: df has few keys of a large dimension."""
    wanted = df.select((F.col(key) if isinstance(key, str) else key).alias("_key")).distinct() if few else None
    found = dim.last_written(wanted).select(*[F.col(p).alias(f"_p_{p}") for p in dim.per], "_key", "_value")
    key = F.col(key) if isinstance(key, str) else key
    on = key == F.col("_key")
    for p in dim.per:
        on = on & (F.col(p) == F.col(f"_p_{p}"))
    value = F.coalesce(F.col("_value").cast("string"), F.lit(dim.default))
    return df.join(found, on, "left").withColumn(name, value).drop("_key", "_value", *[f"_p_{p}" for p in dim.per])
