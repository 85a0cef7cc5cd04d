"""Stamps of many formats and zones to instants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import EARLIEST, LATEST, READ, STATUSES, Stamps, day_month_order
from ..functions.zones import YEARS, zone_tables


def normalised(
    df: DataFrame,
    id_col: str = "import_id",
    start: str = "start_time",
    end: str = "end_time",
    metadata: str = "metadata",
    zone: str = "device_zone",
    locale: str = "file_locale",
    years: tuple[int, int] = YEARS,
    numbers: tuple[int, int] = (EARLIEST, LATEST),
) -> DataFrame:
    """Columns id, ``start_us`` and ``end_us`` (microseconds since 1970 UTC, null where the stamp doesn't denote exactly
    one instant), ``start_status`` and ``end_status`` (see ``masks.STATUSES``) and ``zone_version`` (of the zone tables).

    Method: each stamp is reduced to the mask of its character classes; a mask is matched to its fields once, and all
    stamps of a batch with that mask are converted together; wall times go through tables of zone changes that the
    driver builds from its tz database for ``years`` and that are the same on all executors. It is a map over rows: no
    shuffle, any skew.

    A zone or offset in the stamp goes first, then ``timeZone`` of the JSON in ``metadata`` if such a zone exists, then
    the device's zone. If a stamp has an offset and a zone, the offset counts. Day and month follow the locale; where it
    doesn't tell, only stamps with one possible reading count. Months are names or their first three or four letters, in
    seven languages. Plain numbers are read in the unit in which they lie between the two seconds of ``numbers``. Null, empty, blank and overlong texts, impossible dates,
    unknown abbreviations, wall times that occur twice or never, wall times without a known zone and those in a zone outside
    ``years`` give null and the status that says why. Repeated
    rows are kept; invalid JSON counts as none; extra columns are ignored.
    """
    tables = zone_tables(years)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamps = Stamps(tables, numbers)
        words = pa.array(STATUSES)
        for batch in batches:
            n = batch.num_rows
            wide = batch.column(3).to_pylist()
            device = batch.column(4).to_pylist()
            names = [a if a in tables.zones else b if b in tables.zones else None for a, b in zip(wide, device, strict=True)]
            zones = np.empty(n, object)
            zones[:] = names
            orders_of: dict = {}
            orders = np.array([orders_of.setdefault(x, day_month_order(x)) for x in batch.column(5).to_pylist()], np.int64)
            columns, told = [], []
            for k in (1, 2):
                us, status = stamps.read(batch.column(k).to_pylist(), orders, zones)
                columns.append(pa.array(us, mask=status != READ))
                told.append(words.take(pa.array(status)))
            version = pa.array([tables.version] * n, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *told, version], names=["_id", "_start", "_end", "_told", "_told2", "_version"])

    rows = df.select(
        F.col(id_col).alias("_id"), F.col(start).alias("_a"), F.col(end).alias("_b"),
        F.get_json_object(F.col(metadata), "$.timeZone").alias("_zone"), F.col(zone).alias("_device"), F.col(locale).alias("_locale"),
    )
    kind = dict(rows.dtypes)["_id"]
    done = rows.mapInArrow(convert, f"_id {kind}, _start bigint, _end bigint, _told string, _told2 string, _version string")
    return done.select(
        F.col("_id").alias(id_col), F.col("_start").alias("start_us"), F.col("_end").alias("end_us"),
        F.col("_told").alias("start_status"), F.col("_told2").alias("end_status"), F.col("_version").alias("zone_version")
    )
