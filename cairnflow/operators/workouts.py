"""Workouts as they are sent: statistics of the readings within them, totals and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import positive
from .overlap import within

#: The types of distance in the order in which they are asked for.
DISTANCES = ["distanceWalkingRunning", "distanceCycling", "distanceSwimming", "distanceWheelchair", "distanceDownhillSnowSports"]
HEART = "heartRate"
ENERGY, BASAL = "activeEnergyBurned", "basalEnergyBurned"


def statistics(workouts: DataFrame, readings: DataFrame) -> DataFrame:
    """For each workout and type of reading within it: id, ``sample_type``, n, total, average, lowest, highest.

    ``workouts`` has id, key (the source), lo and hi in seconds; ``readings`` key, sample_type, at and value. Types that no
    total or statistic of a workout uses are left out before the join, so they are never mixed. Null and NaN values and
    null times are no readings; a workout without readings has no row; a repeated id has the readings of all its spans.
    """
    used = readings.where(F.col("sample_type").isin([HEART, ENERGY, BASAL, *DISTANCES])).where("value is not null and not isnan(value)")
    met = within(workouts, used.select("key", "at", F.struct("sample_type", "value").alias("value")))
    flat = met.select("id", F.col("value.sample_type").alias("sample_type"), F.col("value.value").alias("v"))
    return flat.groupBy("id", "sample_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.avg("v").alias("average"), F.min("v").alias("lowest"), F.max("v").alias("highest")
    )


def projected(workouts: DataFrame, stats: DataFrame, activities: DataFrame | None = None) -> DataFrame:
    """``workouts`` with totals and heart rate from ``stats`` (as of ``statistics``), else from their legacy totals.

    ``workouts`` has id and may have legacy_energy, legacy_distance and a code of its activity. Energy is the sum of active
    energy if it is positive, else the legacy total, even 0; basal energy the sum if it is positive; distance the first
    positive sum of the types in order, else the legacy one. Heart rate is that of heart rate readings alone. ``activities``
    (code, label) names the activity; a code that it lacks gives ``activity_`` and the code. Nulls stay null.
    """

    def stat(kind: str, field: str) -> Column:
        return F.max(F.when(F.col("sample_type") == kind, F.col(field)))

    wide = stats.groupBy(F.col("id").alias("_id")).agg(
        stat(ENERGY, "total").alias("_energy"), stat(BASAL, "total").alias("_basal"),
        *[stat(d, "total").alias(f"_d{i}") for i, d in enumerate(DISTANCES)],
        stat(HEART, "average").alias("average_heart_rate"), stat(HEART, "lowest").alias("minimum_heart_rate"), stat(HEART, "highest").alias("maximum_heart_rate"),
    )
    none = F.lit(None).cast("double")
    legacy = {c: F.col(c) if c in workouts.columns else none for c in ("legacy_energy", "legacy_distance")}
    kept = workouts.drop("average_heart_rate", "minimum_heart_rate", "maximum_heart_rate")
    full = kept.join(wide, F.col("id") == F.col("_id"), "left")
    if activities is not None:
        names = F.broadcast(activities.select(F.col("code").alias("_code"), F.col("label").alias("_label")))
        full = full.join(names, F.col("code") == F.col("_code"), "left")
        full = full.withColumn("activity", F.coalesce("_label", F.concat(F.lit("activity_"), F.col("code").cast("string")))).drop("_code", "_label")
    sums = [f"_d{i}" for i in range(len(DISTANCES))]
    return full.withColumns({
        "total_energy": F.coalesce(positive(F.col("_energy")), legacy["legacy_energy"]),
        "basal_energy": positive(F.col("_basal")),
        "total_distance": F.coalesce(*[positive(F.col(c)) for c in sums], legacy["legacy_distance"]),
    }).drop("_id", "_energy", "_basal", *sums)
