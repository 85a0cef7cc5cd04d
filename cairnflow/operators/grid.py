"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def regular_grid(
    df: DataFrame, series: list[str], at: str, value: str, step: int = 3600, max_gap: int = 48, carry: int = 3
) -> DataFrame:
    """A row for every step of each series, with the readings of that step or a mark that there are none.

    ``at`` is in integer seconds. Columns: series, ``step_start`` (seconds), ``n`` (readings), ``mean``, ``filled`` (the
    mean, else the last one at most ``carry`` steps old) and ``state`` (``read``, ``carried`` or ``missing``). Runs of
    ``max_gap`` or more empty steps aren't filled: the series is taken as switched off and continues after them.

    Method: readings are added up to steps before any shuffle; stretches without a longer gap give a sequence of steps,
    to which the steps with readings are left joined on series and step; the last mean is carried forward. What a series
    holds after the first step is bounded by the calendar, not by its readings.

    Rows without ``at`` are left out; null and NaN values are readings of a step but not part of its mean; a null series
    column is a series of its own.
    """
    keys = [f"_s{i}" for i in range(len(series))]
    number = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double"))
    rows = df.where(F.col(at).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(series, keys, strict=True)],
        F.floor(F.col(at) / F.lit(step)).alias("_step"),
        number.alias("_value"),
    )
    steps = rows.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("n"), F.avg("_value").alias("mean"))
    steps = staged(steps)  # read for the sequence and for the join

    by_step = Window.partitionBy(*keys).orderBy("_step")
    ahead = steps.select(*keys, "_step", F.lead("_step").over(by_step).alias("_next"))
    upto = F.when(F.col("_next") - F.col("_step") <= max_gap, F.col("_next") - 1).otherwise(F.col("_step"))
    grid = ahead.select(*keys, F.explode(F.sequence("_step", upto)).alias("_step"))

    right = steps.select(*[F.col(k).alias(f"r{k}") for k in keys], F.col("_step").alias("_at"), "n", "mean")
    same = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys]
    joined = grid.join(right, [F.col("_step") == F.col("_at"), *same], "left")
    back = by_step.rowsBetween(-carry, 0)
    last = F.last(F.when(F.col("n").isNotNull(), F.struct("_step", "mean")), ignorenulls=True).over(back)
    carried = joined.withColumn("_last", last)
    # rows of a grid are successive steps except across a switched-off stretch, hence the check of the age
    fresh = F.col("_step") - F.col("_last._step") <= carry
    return carried.select(
        *[F.col(k).alias(c) for c, k in zip(series, keys, strict=True)],
        (F.col("_step") * F.lit(step)).alias("step_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean",
        F.when(fresh, F.col("_last.mean")).alias("filled"),
        F.when(F.col("n").isNotNull(), "read").when(fresh, "carried").otherwise("missing").alias("state"),
    )
