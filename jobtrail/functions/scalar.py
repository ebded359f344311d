"""Scalar column expressions shared by the operators. All of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_type(*event_types: str) -> Column:
    """True for rows of the given event types; usable with ``count_if`` and ``filter``."""
    if len(event_types) == 1:
        return F.col("event_type") == event_types[0]
    return F.col("event_type").isin(*event_types)


def json_uint(payload: str | Column, key: str) -> Column:
    """A non-negative whole number from JSON text; 0 when missing, invalid or negative."""
    col = F.col(payload) if isinstance(payload, str) else payload
    number = F.get_json_object(col, f"$.{key}").try_cast("bigint")
    return F.greatest(F.coalesce(number, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def duration_ms() -> Column:
    return json_uint("payload", "duration_ms")


def minute(col: str = "event_time") -> Column:
    return F.date_trunc("minute", F.col(col))


def hour(col: str = "event_time") -> Column:
    return F.date_trunc("hour", F.col(col))


def day(col: str = "event_time") -> Column:
    return F.to_date(F.col(col))


def month(col: str = "event_time") -> Column:
    """Month number as yyyymm."""
    return F.year(col) * 100 + F.month(col)


def millis_between(start: str | Column, end: str | Column) -> Column:
    """Milliseconds from start to end, counting millisecond boundaries."""
    return F.unix_millis(end) - F.unix_millis(start)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; 0 when the denominator is 0 or NULL."""
    n, d = num.cast("double"), den.cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def finite(col: Column) -> Column:
    """0 in place of NULL, NaN and infinities."""
    x = col.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def count_of(cond: Column) -> Column:
    """count_if that gives 0, also over an empty input."""
    return F.count_if(cond)


def add_millis(ts: Column, ms: Column) -> Column:
    """ts + ms, exact to the millisecond."""
    return F.timestamp_millis(F.unix_millis(ts) + ms)


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row.

    A plain projection may be merged with the steps above it: an expression that several of them
    use, or a filter on it, then copies it to every place. A one-row generator keeps it apart.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(c) for c in df.columns if c not in columns], made)
