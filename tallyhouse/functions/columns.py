"""Column helpers for text that may be dirty: a value that can't be read gives null or a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Accepted ways to write a moment in ISO form, most precise first.
ISO_PATTERNS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyyMMdd",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_number(df, name: str) -> bool:
    """Whether a column is typed as a number, so that no text has to be read."""
    return dict(df.dtypes)[name].startswith(NUMBERS)


def is_whole(df, name: str) -> bool:
    """Whether a column is typed as a whole number."""
    return dict(df.dtypes)[name].startswith(NUMBERS[:4])


def double_of(df, name: str, default: float = 0.0) -> Column:
    """safe_double() of a column; a column of numbers is taken as it is, so that the scan can use conditions on it."""
    if not is_number(df, name):
        return safe_double(name, default)
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def long_of(df, name: str, default: int = 0) -> Column:
    """safe_long() of a column; a column of whole numbers is taken as it is."""
    if not is_whole(df, name):
        return safe_long(name, default=default)
    return F.coalesce(F.col(name).cast("long"), F.lit(default).cast("long"))


def safe_double(c: Column | str, default: float | None = 0.0) -> Column:
    """The number written in c. A type suffix as in 75d is no number, though a cast would take it."""
    text = F.trim(_col(c).cast("string"))
    return F.coalesce(F.when(~text.rlike("(?i)[0-9.][df]$"), text.try_cast("double")), F.lit(default).cast("double"))


def safe_long(c: Column | str, minimum: int | None = None, default: int = 0) -> Column:
    """The whole part of the number in c. With a minimum, text with a fraction and smaller numbers give the default."""
    if minimum is None:
        return F.coalesce(safe_double(c, None).try_cast("long"), F.lit(default).cast("long"))
    text = F.trim(_col(c).cast("string"))
    n = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.coalesce(F.when(n >= minimum, n), F.lit(default).cast("long"))


def strict_timestamp(c: Column | str) -> Column:
    """yyyy-MM-dd HH:mm:ss with all zeros written, as timestamp_ntz; else null."""
    text = _col(c).cast("string")
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")


def lenient_timestamp(c: Column | str) -> Column:
    """As strict_timestamp, but leading zeros may be missing."""
    return F.try_to_timestamp(_col(c).cast("string"), F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz")


def iso_timestamp(c: Column | str) -> Column:
    """Any of ISO_PATTERNS, as timestamp_ntz; else null."""
    text = _col(c).cast("string")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ISO_PATTERNS)).cast("timestamp_ntz")


def time_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def year_half(ts: Column | str) -> Column:
    ts = _col(ts)
    return F.when(ts.isNotNull(), F.concat(F.year(ts).cast("string"), F.when(F.month(ts) <= 6, "-H1").otherwise("-H2")))


def year_month(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def year_month_text(c: Column | str) -> Column:
    """Month of a text with a moment in it, zeros written or not; of other text of 7 characters at least, these."""
    text = _col(c).cast("string")
    return F.coalesce(year_month(lenient_timestamp(text)), F.when(F.length(text) >= 7, F.substring(text, 1, 7)))


def year_half_text(c: Column | str) -> Column:
    """Half-year of a text with a moment in it, zeros written or not, or of ISO text; else null."""
    return F.coalesce(year_half(lenient_timestamp(c)), year_half(iso_timestamp(c)))


def normalized_half(raw: Column | str, year: Column | str | None = None, semester: Column | str | None = None) -> Column:
    """struct(text, year, semester) from forms as 2024-H1, 2024-1 or 2024h2; other columns stand in where raw can't be read.

    Text that can't be read comes back trimmed.
    """
    pattern = r"^\s*(\d{4})\s*-?\s*[hH]?\s*([12])\s*$"
    raw = _col(raw).cast("string")
    y = F.regexp_extract(raw, pattern, 1).try_cast("int")
    s = F.regexp_extract(raw, pattern, 2).try_cast("int")
    if year is not None and semester is not None:
        y = F.coalesce(y, _col(year).cast("string").try_cast("int"))
        s = F.coalesce(s, F.regexp_extract(_col(semester).cast("string"), r"([12])\s*$", 1).try_cast("int"))
    text = F.when(y.isNotNull() & s.isNotNull(), F.concat(y.cast("string"), F.lit("-H"), s.cast("string"))).otherwise(F.trim(raw))
    return F.struct(text.alias("text"), y.alias("year"), s.alias("semester"))


def normalized_month(raw: Column | str) -> Column:
    """struct(text, year, month) with the month padded to two digits."""
    raw = _col(raw).cast("string")
    y = F.regexp_extract(raw, r"^\s*(\d{4})-(\d{1,2})", 1).try_cast("int")
    m = F.regexp_extract(raw, r"^\s*(\d{4})-(\d{1,2})", 2).try_cast("int")
    text = F.when(m.between(1, 12), F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
    return F.struct(text.alias("text"), y.alias("year"), m.alias("month"))


def id_order(c: Column | str) -> list[Column]:
    """Order of ids that may be text: by number first (0 where there is none), then by text."""
    text = _col(c).cast("string")
    return [F.coalesce(text.try_cast("double").try_cast("long"), F.lit(0)), text]


def shard_id(key: Column | str, shards: int) -> Column:
    """md5 of the key as text, read as a 128-bit number, modulo shards; for shards under 2^31."""
    digest = F.md5(_col(key).cast("string"))
    rest = F.lit(0).cast("long")
    for k in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
        rest = (rest * ((1 << 32) % shards) + part % shards) % shards
    return rest.cast("int")


def fixed_point(c: Column | str) -> Column:
    """Rounded to the 6 decimals that amounts are written with."""
    return F.round(_col(c), 6)


def as_decimal(c: Column | str) -> Column:
    """For sums that must not depend on the order of the rows."""
    return _col(c).cast("decimal(18,6)")


def safe_date(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c).cast("string"), F.lit("yyyy-MM-dd")).cast("date")


def is_positive(c: Column | str) -> Column:
    return F.coalesce(safe_double(c, None) > 0, F.lit(False))


def money(c: Column | str) -> Column:
    """Two decimals, halves away from zero; by way of a decimal, so the binary form of a double doesn't decide."""
    return F.coalesce(F.round(_col(c).cast("decimal(18,6)"), 2).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).cast("string")
