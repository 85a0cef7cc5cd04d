"""Ordered series cut into chunks of bounded size with neighbouring rows on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from ..sources.tables import bounded_rows

#: Rows of a series that one chunk holds at most, but for a single stretch with more.
TARGET = 50_000
#: Seconds of a stretch, the least piece of a chunk.
STRETCH_S = 86400
#: A map of at most so many stretches is sent to all tasks; a larger one is joined by a shuffle.
SMALL_MAP = 50_000


def chunked(
    df: DataFrame, series: list[str], at: str, halo: int, target: int = TARGET, stretch: int = STRETCH_S
) -> DataFrame:
    """``df`` with ``_chunk`` (number within the series) and ``_core`` (false for a copy that serves as a neighbour).

    ``at`` is in integer seconds. Series of at most ``target`` rows are one chunk. A longer one is cut at stretches of
    time such that chunks have about ``target`` rows; each chunk also gets copies of the stretches before and after
    until these hold at least ``halo`` rows, so every row of the core has its ``halo`` nearest rows on either side.
    Sizes come from one pass of counts, which are written; no series is gathered in one task. A null series column makes a
    series of its own.
    """
    spark = df.sparkSession
    cut = df.withColumn("_cut", F.floor(F.col(at) / F.lit(stretch)))
    counts = staged(cut.groupBy(*series, "_cut").agg(F.count(F.lit(1)).alias("_n")))
    large = counts.groupBy(*series).agg(F.sum("_n").alias("_all")).where(F.col("_all") > target)
    if large.isEmpty():
        return df.withColumns({"_chunk": F.lit(0).cast("bigint"), "_core": F.lit(True)})
    names = [f"_k{i}" for i in range(len(series))]
    big = large.select(*[F.col(c).alias(n) for c, n in zip(series, names, strict=True)])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(series, names, strict=True)]
    counts = counts.join(big, same, "left_semi")
    order = Window.partitionBy(*series).orderBy("_cut")
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select(*series, "_cut", "_n", upto.alias("_end")).withColumn("_begin", F.col("_end") - F.col("_n"))
    placed = placed.withColumn("_own", F.floor(F.col("_begin") / F.lit(target)))
    # chunk c holds the stretches that begin at rows c * target up to (c + 1) * target
    first = F.min("_begin").over(Window.partitionBy(*series, "_own"))
    last = F.max("_end").over(Window.partitionBy(*series, "_own"))
    placed = placed.withColumns({"_first": first, "_last": last})
    edges = placed.select(*[F.col(c).alias(n) for c, n in zip(series, names, strict=True)], F.col("_own").alias("_c"), "_first", "_last").distinct()
    # a stretch serves chunk c if it meets the rows [first - halo, last + halo) of c; both sides are laid out on cells of
    # target rows, and meet in a cell before they are compared
    def cells(begin: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.expr(begin) / F.lit(target)), F.floor(F.expr(end) / F.lit(target))))

    wide = edges.withColumn("_near", cells(f"_first - {halo}", f"_last + {halo}"))
    pairs = placed.drop("_first", "_last").withColumn("_cell", cells("_begin", "_end")).join(wide, [F.col("_cell") == F.col("_near"), *same])
    meets = (F.col("_end") > F.col("_first") - halo) & (F.col("_begin") < F.col("_last") + halo)
    core = (F.col("_c") == F.col("_own")).alias("_core")
    lookup = pairs.where(meets).select(*names, F.col("_cut").alias("_stretch"), F.col("_c").alias("_chunk"), core).distinct()
    known = bounded_rows(lookup, SMALL_MAP)
    if known is not None:
        lookup = F.broadcast(spark.createDataFrame(known, lookup.schema))
    joined = cut.join(lookup, [F.col("_cut") == F.col("_stretch"), *same], "left")
    return joined.select(*df.columns, F.coalesce("_chunk", F.lit(0)).alias("_chunk"), F.coalesce("_core", F.lit(True)).alias("_core"))
