"""Filters of the business questions, as conditions that the scan and the optimizer can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import columns as C


def year_in(ts: Column | str, years: tuple[int, int]) -> Column:
    """The year is one of the two; where they follow each other, a range of ts lets a scan skip row groups."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    test = F.year(ts).isin(*years)
    if abs(years[0] - years[1]) <= 1:
        lo, hi = min(years), max(years) + 1
        return (ts >= F.lit(f"{lo}-01-01 00:00:00").cast("timestamp_ntz")) & (ts < F.lit(f"{hi}-01-01 00:00:00").cast("timestamp_ntz"))
    return F.coalesce(test, F.lit(False))


def time_between(ts: Column | str, start: str, end: str) -> Column:
    """Time of day from start to end, both included, in whole seconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    number = lambda t: sum(int(x) * y for x, y in zip(t.split(":"), (3600, 60, 1)))
    return F.coalesce(seconds.between(number(start), number(end)), F.lit(False))


def amount_at_least(c: Column | str, least: float, typed: bool = False) -> Column:
    """Unreadable amounts are 0; not-a-number passes no bound. typed: c is a number, so that the scan can use the condition."""
    if typed:
        c = F.col(c) if isinstance(c, str) else c
        return (F.coalesce(c, F.lit(0.0)) >= least) & ~F.isnan(c) if least <= 0 else (c >= least) & ~F.isnan(c)
    value = C.safe_double(c)
    return (value >= least) & ~F.isnan(value)


def keep(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet all conditions."""
    for c in conditions:
        df = df.filter(c)
    return df


def has_key(df: DataFrame, *names: str) -> DataFrame:
    return keep(df, *(F.col(n).isNotNull() for n in names))


def rankable(df: DataFrame) -> DataFrame:
    """Rows with a store, a known user and a positive quantity, which may be named purchases_qty or purchase_qty."""
    named = [c for c in ("purchases_qty", "purchase_qty") if c in df.columns]
    whole = lambda c: F.col(c).cast("long") if C.is_whole(df, c) else C.safe_long(c, 0)
    qty = F.coalesce(*map(whole, named), F.lit(0).cast("long"))
    rest = [c for c in df.columns if c not in named]
    out = df.select(*rest, qty.alias("purchases_qty"))
    return out.where((F.coalesce(F.trim(F.col("store_id").cast("string")), F.lit("")) != "") & (whole("user_id") > 0) & (F.col("purchases_qty") > 0))


def usable_dimension(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose id and value are neither null nor blank."""
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    return df.where((text(key) != "") & (text(value) != ""))
