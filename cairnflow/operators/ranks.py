"""Ranks within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_rank(df: DataFrame, group: list[str], order: str, width: int, rank: str) -> DataFrame:
    """``df`` with the 1-based rank of each row within its group by ``order``, an integer column without nulls.

    Rows are sorted within stretches of ``width`` of the order; a stretch starts at the number of rows of the group's
    earlier stretches. A group is thus spread over as many tasks as it has stretches. The sizes of the stretches come from
    the rows as they lie after the one shuffle, which both uses share, so ``df`` is computed once. Equal rows get
    successive ranks in any order.
    """
    cut = df.withColumn("_cut", F.floor(F.col(order) / F.lit(width))).where("_cut is not null").repartition(*group, "_cut")
    stretch = Window.partitionBy(*group, "_cut").orderBy(order)
    local = cut.withColumn("_local", F.row_number().over(stretch))
    earlier = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    # the greatest value keeps ``order`` among the columns read, without which the shuffle couldn't be shared
    counts = cut.groupBy(*group, "_cut").agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_top")).where("_top is not null")
    starts = counts.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_cut").alias("_at_cut"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    on = [F.col("_cut") == F.col("_at_cut"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]]
    ranked = local.join(starts, on)
    return ranked.withColumn(rank, F.col("_before") + F.col("_local")).select(*df.columns, rank)
