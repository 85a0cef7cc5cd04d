"""Landed bodies into tables, exactly once in effect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import ingest
from ..sources.landing import append_samples, decoded, landed_stream, repaired

SAMPLES = "uuid string, sample_type string, payload string, received_at timestamp, file string, pos int, run string, batch_id bigint, type_stem string"
TOMBSTONES = "uuid string, received_at timestamp, file string, pos int, run string, batch_id bigint"


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; it is made with the checkpoint and kept in it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/run-of-loads")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, False)
        out.write(bytearray(uuid.uuid4().hex, "ascii"))
        out.close()
    return spark.read.text(path.toString()).first()[0]


class Store:
    """Tables of a folder: samples, tombstones, quarantine and deliveries.

    Each batch of a run has parts of its own, which a replay after a failure writes again; rows of other batches are what
    it is held against. A re-import with a new checkpoint is another run: it finds its rows in the tables, adds none and
    counts none, and leaves the records of earlier runs. Dedupe state is the stored table itself, joined by uuid, so it
    has no time bound and no state store. One writer per folder.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def samples(self) -> DataFrame:
        return self.table("samples", SAMPLES)

    def tombstones(self) -> DataFrame:
        return self.table("tombstones", TOMBSTONES)

    def quarantine(self) -> DataFrame:
        return self.table("quarantine", "file string, reason string, run string, batch_id bigint")

    def deliveries(self) -> DataFrame:
        return self.table("deliveries", "received bigint, `new` bigint, deleted bigint, run string, batch_id bigint")

    def load(self, bodies: DataFrame, batch_id: int, run: str = "direct") -> None:
        """One micro-batch of landed bodies (path, modificationTime, content)."""
        stamp = F.current_timestamp()
        part = f"run={run}/batch_id={batch_id}"
        others = ~((F.col("run") == run) & (F.col("batch_id") == batch_id))
        texts = repaired(decoded(bodies.select(F.col("path").alias("file"), "modificationTime", "content"))).persist()
        try:
            broken = texts.where("status <> 200").select("file", F.col("status").cast("string").alias("reason"))
            refused = ingest.rejected(texts.where("status = 200")).select("file", "reason")
            broken.unionByName(refused).write.mode("overwrite").parquet(f"{self.folder}/quarantine/{part}")

            split = ingest.elements(texts.where("status = 200").select("file", "modificationTime", "body"))
            order = ["modificationTime", "file", "pos"]
            added, gone = Observation(), Observation()
            rows = ingest.samples_of(split).withColumn("payload", F.to_json("el")).drop("el")
            fresh = ingest.new_only(ingest.first_wins(rows, "uuid", order), self.samples().where(others))
            fresh = fresh.select("uuid", "sample_type", "payload", stamp.alias("received_at"), "file", "pos", "type_stem")
            append_samples(fresh.observe(added, F.count(F.lit(1)).alias("n")), f"{self.folder}/samples/{part}")

            ids = ingest.first_tombstones(ingest.tombstones_of(split), order)
            ids = ingest.new_only(ids, self.tombstones().where(others)).select("uuid", stamp.alias("received_at"), "file", "pos")
            ids.observe(gone, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.folder}/tombstones/{part}")

            received = split.agg(F.count(F.lit(1)).alias("received"))
            counts = received.select("received", F.lit(added.get["n"]).alias("new"), F.lit(gone.get["n"]).alias("deleted"))
            counts.write.mode("overwrite").parquet(f"{self.folder}/deliveries/{part}")
        finally:
            texts.unpersist()

    def start(self, landing: str, checkpoint: str, per_trigger: int = 1000, frequency: str | None = None) -> StreamingQuery:
        """Loads what lies in ``landing`` since the checkpoint. A new checkpoint is a full re-import.

        ``frequency`` of the registry keeps the query going: ``immediate`` as fast as bodies come, ``hourly`` once an hour;
        without one it ends when everything is loaded.
        """
        run = run_of(self.spark, checkpoint)
        stream = landed_stream(self.spark, landing, per_trigger)
        writer = stream.writeStream.foreachBatch(lambda df, n: self.load(df, n, run)).option("checkpointLocation", checkpoint)
        every = {None: {"availableNow": True}, "immediate": {"processingTime": "0 seconds"}, "hourly": {"processingTime": "1 hour"}}
        return writer.trigger(**every[frequency]).start()
