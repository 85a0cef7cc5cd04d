"""Settings and status as small tables of keys and JSON values. Secrets don't belong here."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "key string, value string, saved_at timestamp, version string"
SECRET = ("token", "password", "secret")


class Settings:
    """Keys with JSON values in a folder. A save appends; the last one of a key counts, so a reader never sees a half-written table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, values: dict) -> None:
        """Raises for a key that names a secret."""
        if bad := [k for k in values if any(s in k.lower() for s in SECRET)]:
            raise ValueError(f"secrets are not kept in tables: {bad}")
        rows = [(k, json.dumps(v)) for k, v in values.items()]
        df = self.spark.createDataFrame(rows, "key string, value string")
        df.select("key", "value", F.current_timestamp().alias("saved_at"), F.lit(uuid.uuid4().hex).alias("version")).coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        """The last value of each key."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.folder)
        except AnalysisException:  # not written yet
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("key").agg(F.max_by("value", F.struct("saved_at", "version")).alias("value"))

    def load(self) -> dict:
        return {r.key: json.loads(r.value) for r in self.table().collect()}

    def enabled(self, types: list[str]) -> list[str]:
        """The types that are enabled: all but those whose entry in the setting ``enabled`` is false. Entries that are no
        booleans count as absent."""
        stored = self.load().get("enabled")
        off = {k for k, v in stored.items() if v is False} if isinstance(stored, dict) else set()
        return [t for t in types if t not in off]
