"""Overlapping intervals merged to continuous periods, and the gaps between these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import spread_rank

#: Stretch of time, in seconds, whose boundaries of one entity are sorted in one task.
STRETCH_S = 86400
#: Periods of one entity that are ranked in one task.
PERIODS = 100_000


def _paired(df: DataFrame, entity: str, start: str, end: str, stretch: int) -> DataFrame:
    """For each entity and rank r from 0: ``_end`` of rank r and ``_start`` of rank r + 1, null where there is none.

    The table is read once: its intervals become boundaries, starts and ends are ranked independently by the same pass,
    and the pairs meet by their rank in an aggregate.
    """
    cols = F.col(entity).alias("_entity"), F.col(start).cast("bigint").alias("_start"), F.col(end).cast("bigint").alias("_end")
    sides = F.array(F.struct(F.lit(0).alias("kind"), F.col("_start").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("_end").alias("at")))
    flat = df.select(*cols).where("_start < _end").select("_entity", F.explode(sides).alias("_side"))
    flat = flat.select("_entity", F.col("_side.kind").alias("_kind"), F.col("_side.at").alias("_at"))
    ranked = spread_rank(flat, ["_entity", "_kind"], "_at", stretch, "_rank")
    rank = (F.col("_rank") - 1 + F.col("_kind")).alias("_r")
    sides = ranked.select("_entity", rank, F.when(F.col("_kind") == 1, F.col("_at")).alias("_end"), F.when(F.col("_kind") == 0, F.col("_at")).alias("_start"))
    return sides.groupBy("_entity", "_r").agg(F.max("_end").alias("_end"), F.max("_start").alias("_start"))


def gaps(df: DataFrame, entity: str, start: str, end: str, stretch: int = STRETCH_S) -> DataFrame:
    """Gaps between the successive periods of each entity: entity, gap_start, gap_end.

    ``start`` and ``end`` are integers, an interval holds [start, end). Method: starts and ends are sorted independently
    and ranked; where the start of rank r + 1 exceeds the end of rank r, all r intervals begun so far have ended, and
    the two are the sides of a gap. The sort is spread over stretches of time, so an entity with a third of all rows
    occupies many tasks, and pairs meet on entity and rank.

    Only intervals that end after their start count: empty and reversed ones, and those with a null bound, are left out.
    Intervals that touch leave no gap. A null entity is one of its own. Equal intervals change nothing. Other columns are
    ignored; an empty table gives no gaps.
    """
    return _paired(df, entity, start, end, stretch).where("_start > _end").select(
        F.col("_entity").alias(entity), F.col("_end").alias("gap_start"), F.col("_start").alias("gap_end")
    )


def periods(df: DataFrame, entity: str, start: str, end: str, stretch: int = STRETCH_S) -> DataFrame:
    """Continuous periods of each entity: entity, period_start, period_end. Cases as in ``gaps``.

    Pairs between which there is a gap, and those at either end, are the places where one period ends and the next begins;
    in order of rank, the start at one place and the end at the next are a period's sides.
    """
    places = _paired(df, entity, start, end, stretch).where("_start is null or _end is null or _start > _end")
    ranked = spread_rank(places, ["_entity"], "_r", PERIODS, "_k")
    sides = F.array(F.struct(F.col("_k").alias("k"), F.col("_start").alias("a"), F.lit(None).cast("bigint").alias("b")), F.struct((F.col("_k") - 1).alias("k"), F.lit(None).cast("bigint").alias("a"), F.col("_end").alias("b")))
    flat = ranked.select("_entity", F.explode(sides).alias("_s")).select("_entity", F.col("_s.k").alias("_k"), F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"))
    both = flat.groupBy("_entity", "_k").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a is not null and _b is not null")
    return both.select(F.col("_entity").alias(entity), F.col("_a").alias("period_start"), F.col("_b").alias("period_end"))
