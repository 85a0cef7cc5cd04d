"""Parquet tables of a data directory, and bounded reads of dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension of at most so many rows may be turned into literals of a plan.
SMALL_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, one parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """The rows of ``df``, or None if there are more than ``limit``; never more than ``limit + 1`` reach the driver."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def filter_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` occurs in the one column of ``keys``.

    A checked small set of keys becomes a filter that the parquet scan can take; a larger one a semi join. Null matches
    nothing.
    """
    key = keys.columns[0]
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    rows = bounded_rows(wanted)
    if rows is not None:
        return df.where(F.col(column).isin([r[0] for r in rows]) if rows else F.lit(False))
    return df.join(wanted.withColumnRenamed(key, "_key"), F.col(column) == F.col("_key"), "left_semi")


def types_of_shape(spark: SparkSession, sf_dir: str, *shapes: str) -> DataFrame:
    """Names of the sample types of the given shapes."""
    return table(spark, sf_dir, "sample_types").where(F.col("shape").isin(list(shapes))).select("sample_type")
