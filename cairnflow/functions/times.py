"""Instants as counts since 1970 in UTC, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp_instant(column: str | Column) -> Column:
    """ISO 8601 text to a TIMESTAMP, null where it isn't one. Text without an offset counts as UTC."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    zoned = F.when(text.rlike(r"T.*(Z|z|[+-]\d\d(:?\d\d)?)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def stamp_seconds(column: str | Column) -> Column:
    """ISO 8601 text to seconds since 1970."""
    return F.unix_seconds(stamp_instant(column))


def instant(seconds: Column) -> Column:
    """Seconds since 1970 to a TIMESTAMP_NTZ in UTC."""
    rest = F.pmod(seconds, F.lit(86400))
    span = F.make_dt_interval(((seconds - rest) / F.lit(86400)).cast("int"), F.lit(0), F.lit(0), rest.cast("decimal(18, 6)"))
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + span


def micros(df: DataFrame, column: str) -> Column:
    """A timestamp column, with or without zone, to microseconds since 1970; one without zone means UTC."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp":
        return F.unix_micros(F.col(column))
    if kind == "timestamp_ntz":
        span = f"`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        return F.expr(f"cast(cast(cast({span} as interval second) as decimal(18, 6)) * 1000000 as bigint)")
    return F.unix_micros(stamp_instant(column))


def day_number(seconds: Column) -> Column:
    """Seconds since 1970 to the number of the UTC day."""
    return F.floor(seconds / F.lit(86400)).cast("int")


def day_text(number: Column) -> Column:
    """The number of a day to YYYY-MM-DD."""
    return F.date_from_unix_date(number).cast("string")
