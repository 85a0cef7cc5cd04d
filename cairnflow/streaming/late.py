"""Aggregates of a stream by event time, closed by watermarks of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import late
from ..operators.late import TOTALS, Lateness


class Ledger:
    """What a stream of records (the keys, at_s, arrived_us, value) has brought so far, kept as tables of a folder.

    Micro-batches come in order of arrival. Each one moves the watermarks of its sources, judges its own late records
    against the punctuations so far and adds its sums; the functions are those of ``operators.late``, so any cut into
    micro-batches gives what the whole table gives. The clock is that of the arrivals: a replay of old records closes
    nothing early. Each batch has parts under its number, overwritten if it is replayed; a new checkpoint starts with an
    empty folder. What is read per batch is bounded by the calendar: the watermarks and the pairs of scope and source.
    """

    def __init__(self, spark: SparkSession, folder: str, rule: Lateness, at: str = "at_s", arrived: str = "arrived_us", value: str = "value") -> None:
        self.spark, self.folder, self.rule = spark, folder.rstrip("/"), rule
        self.columns = (at, arrived, value)

    def _read(self, name: str, like: DataFrame) -> DataFrame:
        try:
            return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # not written yet
            return like.limit(0)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/part={batch_id}")

    def add(self, records: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        rule = self.rule
        rows = late.placed(records, rule, *self.columns).persist()
        try:
            own = late.marked(rows, rule)
            earlier = self._read(f"marks/part={batch_id - 1}", own) if batch_id else own.limit(0)
            self._write(late.merged(earlier, own, rule), "marks", batch_id)
            marks = self._read(f"marks/part={batch_id}", own)
            periods, members = late.of_scopes(rows, rule)
            before = self._read(f"members/part={batch_id - 1}", members) if batch_id else members.limit(0)
            self._write(before.unionByName(members).distinct(), "members", batch_id)
            asked = late.asked_for(periods, self._read(f"members/part={batch_id}", members), rule)
            judged = late.judged(late.after_publication(rows, rule), late.punctuated(marks, asked, rule), rule)
            self._write(late.summed(rows, judged, rule), "sums", batch_id)
            self._write(judged.where("_dropped"), "diverted", batch_id)
            self._write(periods, "periods", batch_id)
            self.last = batch_id
        finally:
            rows.unpersist()

    def outcomes(self) -> DataFrame:
        """The aggregates so far, as of ``operators.late.period_outcomes``."""
        rule, read = self.rule, self.spark.read.parquet
        sums = read(f"{self.folder}/sums").groupBy(*rule.keys, "_period").agg(*[F.sum(c).alias(c) for c in TOTALS])
        marks = read(f"{self.folder}/marks/part={self.last}")
        periods = read(f"{self.folder}/periods").select(*rule.within, "_period").distinct()
        asked = late.asked_for(periods, read(f"{self.folder}/members/part={self.last}"), rule)
        return late.finished(sums, late.punctuated(marks, asked, rule), rule)

    def diverted(self) -> DataFrame:
        """The records that came after their period's closing."""
        return self.spark.read.parquet(f"{self.folder}/diverted").drop("_dropped", "_corrects", "_latest", "_n", "part")

    def start(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        """Adds what the stream brings until it has no more."""
        writer = records.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
