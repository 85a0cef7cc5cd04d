"""An incremental source: rows after an anchor, the anchor being the stream's offset."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class RowGroup(InputPartition):
    """The rows of one row group of one file with low < key <= high."""

    def __init__(self, path: str, group: int, low: int, high: int) -> None:
        self.path, self.group, self.low, self.high = path, group, low, high


class AnchoredReader(DataSourceStreamReader):
    """Rows with anchor < key <= offset; executors read the row groups that may hold some.

    The driver reads footers only: the greatest key is that of the row groups' statistics. A row group without statistics
    is scanned for its greatest key, batch by batch.
    """

    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.key, self.names = options["path"], options["key"], names

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """Path and number of each row group with the least and the greatest key in it."""
        for whole in ds.dataset(self.path, format="parquet").get_fragments():
            for part in whole.split_by_row_group():
                group = part.row_groups[0]
                held = group.statistics.get(self.key) if group.statistics else None
                if held is None:
                    seen = [x for b in part.scanner(columns=[self.key]).to_batches() for x in _bounds(b.column(0))]
                    held = {"min": min(seen), "max": max(seen)} if seen else None
                if held is not None and held["max"] is not None:
                    yield part.path, group.id, held["min"], held["max"]

    def initialOffset(self) -> dict:
        return {"anchor": -1}

    def latestOffset(self) -> dict:
        self.anchor = max([getattr(self, "anchor", -1), *(top for *_, top in self._groups())])
        return {"anchor": self.anchor}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        low, high = start["anchor"], end["anchor"]
        self.anchor = max(getattr(self, "anchor", -1), high)
        return [RowGroup(path, group, low, high) for path, group, least, top in self._groups() if top > low and least <= high]

    def read(self, partition: RowGroup) -> Iterator:
        among = (ds.field(self.key) > partition.low) & (ds.field(self.key) <= partition.high)
        whole = next(iter(ds.dataset(partition.path, format="parquet").get_fragments()))
        yield from whole.subset(row_group_ids=[partition.group]).scanner(columns=self.names, filter=among).to_batches()


def _bounds(column) -> list[int]:
    import pyarrow.compute as pc

    both = pc.min_max(column).as_py()
    return [] if both["min"] is None else [both["min"], both["max"]]


class AnchoredSource(DataSource):
    """Stream of a growing parquet table in order of a bigint key. Options: path, key, columns (DDL)."""

    @classmethod
    def name(cls) -> str:
        return "anchored"

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema) -> AnchoredReader:
        return AnchoredReader(self.options, schema.fieldNames())


def anchored(spark: SparkSession, path: str, key: str, columns: str):
    """``path`` as a stream of the given columns; its offset is the greatest key read, kept in the checkpoint.

    A micro-batch holds all rows that are there, however many: nothing passes the driver but bounds of row groups. Keys
    must grow: a row whose key is not above the anchor when it is written is not read. Null keys are left out.
    """
    spark.dataSource.register(AnchoredSource)
    return spark.readStream.format("anchored").options(path=path, key=key, columns=columns).load()
