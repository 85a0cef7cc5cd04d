"""At-least-once deliveries reduced to one row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, id_col: str, content: list[str], arrival: str | None = None) -> DataFrame:
    """One row for each id and content, with the earliest arrival.

    A delivery that is repeated has the content of the first, so the content is part of the grouping key: all columns of
    the aggregate have a fixed width, it stays a hash aggregate, and repeats collapse before the shuffle however many
    there are. Rows without id are told apart by their content alone. Null contents are equal to each other; a null
    arrival is later than any other. Other columns are dropped.
    """
    keys = [id_col, *[c for c in content if c != id_col]]
    if arrival is None:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min(arrival).alias(arrival))
