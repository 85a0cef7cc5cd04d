"""Totals and averages over trailing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = "decimal(38, 6)"


def trailing_totals(
    df: DataFrame, entity: list[str], day: str, value: str, spans: tuple[int, ...] = (7, 30), max_idle: int = 20
) -> DataFrame:
    """Totals over the last ``spans`` days for each entity and day, days without rows included.

    ``day`` is a DATE column. Days looked at are those with rows, and those in idle stretches of at most ``max_idle``
    days between two days with rows. Columns: entity, day, ``n`` (rows of the day), and for each span k ``t{k}`` (total,
    a double), ``n{k}`` (rows) and ``avg{k}`` (total divided by k).

    Method: prefix sums per entity over daily totals, carried forward into idle days; a total is the prefix at the day
    less the last prefix at or before the day ``k`` days earlier. Sums are decimals of six places, so the differences
    are exact. Rows are added up to days before they are shuffled; what is left per entity is bounded by the calendar,
    so one entity with a third of all rows costs no more than any other.

    Rows without a day are left out; a null entity column is an entity of its own; null, NaN and infinite values count
    as rows of value 0. An empty table gives an empty result; other columns of ``df`` are ignored.
    """
    rows = df.select(
        *[F.col(c).alias(f"_e{i}") for i, c in enumerate(entity)],
        F.unix_date(F.col(day)).alias("_day"),
        F.col(value).try_cast("decimal(28, 6)").alias("_value"),
    ).where("_day is not null")
    keys = [f"_e{i}" for i in range(len(entity))]
    daily = rows.groupBy(*keys, "_day").agg(F.sum("_value").alias("_sum"), F.count(F.lit(1)).alias("_rows"))

    by_day = Window.partitionBy(*keys).orderBy("_day")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixed = daily.select(
        *keys,
        "_day",
        "_rows",
        F.sum(F.coalesce(F.col("_sum"), F.lit(0).cast("decimal(28, 6)"))).over(upto).cast(EXACT).alias("_prefix"),
        F.sum("_rows").over(upto).alias("_count"),
        F.lead("_day").over(by_day).alias("_next"),
    )
    last = F.when(F.col("_next") - F.col("_day") - 1 <= max_idle, F.col("_next") - 1).otherwise(F.col("_day"))
    filled = prefixed.select(
        *keys, "_prefix", "_count", "_rows", F.col("_day").alias("_seen"), F.explode(F.sequence("_day", last)).alias("_day")
    )
    out = [F.col(k).alias(c) for k, c in zip(keys, entity, strict=True)]
    out += [F.date_from_unix_date("_day").alias(day), F.when(F.col("_seen") == F.col("_day"), F.col("_rows")).otherwise(0).alias("n")]
    for k in spans:
        before = by_day.rangeBetween(Window.unboundedPreceding, -k)
        total = (F.col("_prefix") - F.coalesce(F.last("_prefix").over(before), F.lit(0).cast(EXACT))).cast("double")
        rows_in = F.col("_count") - F.coalesce(F.last("_count").over(before), F.lit(0))
        out += [total.alias(f"t{k}"), rows_in.alias(f"n{k}"), (total / k).alias(f"avg{k}")]
    return filled.select(*out)
