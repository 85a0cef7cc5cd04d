"""Statistics of point readings within intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(intervals: DataFrame, points: DataFrame, width: int = 3600) -> DataFrame:
    """A row per interval (id, key, lo, hi) and point (key, at, value) of the same key with lo <= at <= hi.

    Both sides are laid out on cells of ``width``; the join is on key and cell, so it hashes, and a busy key is spread
    over its cells. ``lo``, ``hi`` and ``at`` are integers; nulls match nothing; intervals that end before they start
    match nothing.
    """
    cells = F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))
    left = intervals.where("lo <= hi").select("id", F.col("key").alias("_key"), "lo", "hi", F.explode(cells).alias("_cell"))
    right = points.where("at is not null").select(F.col("key").alias("_k2"), "at", "value", F.floor(F.col("at") / width).alias("_c2"))
    met = left.join(right, (F.col("_key") == F.col("_k2")) & (F.col("_cell") == F.col("_c2")))
    return met.where("at between lo and hi").select("id", F.col("_key").alias("key"), "lo", "hi", "at", "value")
