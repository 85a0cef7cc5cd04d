"""Landed request bodies, the stored samples and the log."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import request_status

#: Fixed value: bytes of a body, compressed and not, that are accepted.
MOST_BYTES = 64 << 20
STEP = 1 << 16


def unpacked(content: bytes | None, most: int = MOST_BYTES) -> tuple[int, str | None]:
    """Status and text of a body: 200, 400 for nothing, bad or truncated gzip and bad UTF-8, 413 for more than ``most`` bytes.

    A body that begins like gzip is decompressed, its first member only and never beyond ``most`` bytes.
    """
    if not content:
        return 400, None
    if len(content) > most:
        return 413, None
    data = content
    if content[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(wbits=31)
        try:
            data = reader.decompress(content, most + 1)
        except zlib.error:
            return 400, None
        if len(data) > most:
            return 413, None
        if not reader.eof:
            return 400, None
    try:
        return 200, data.decode("utf-8")
    except UnicodeDecodeError:
        return 400, None


def decoded(bodies: DataFrame, content: str = "content", most: int = MOST_BYTES) -> DataFrame:
    """``bodies`` with ``content`` replaced by ``status`` and ``body``, batch by batch."""
    kept = [c for c in bodies.columns if c != content]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [unpacked(x.as_py(), most) for x in batch.column(len(kept))]
            arrays = [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, "status", "body"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in bodies.select(*kept).schema)
    return bodies.select(*kept, content).mapInArrow(walk, f"{fields}status int, body string")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies that lie in a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(folder)


def landed_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """The same as a stream, in order of arrival. Binary, as one bad gzip body would stop a text stream."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines as a VARIANT column ``v``; lines that can't be read are left out, lines that are no objects kept."""
    return spark.read.option("singleVariantColumn", "v").json(folder).where("v is not null")


def reloaded(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids that stored lines hold, of samples and of tombstones: two tables of distinct ``uuid``.

    ``lines`` is as of ``stored_lines``. A line with a list ``deleted`` is a tombstone; any other object with a text
    ``uuid`` is a sample. Lines that are neither are left out, also those that are no objects.
    """
    has = F.try_variant_get("v", "$.deleted", "variant").isNotNull()
    own = F.try_variant_get("v", "$.uuid", "variant")
    samples = lines.where(~has & (F.schema_of_variant(own) == "STRING")).select(F.try_variant_get(own, "$", "string").alias("uuid"))
    ids = lines.where(has).select(F.explode(F.try_variant_get("v", "$.deleted", "array<variant>")).alias("_id"))
    gone = ids.where(F.schema_of_variant("_id") == "STRING").select(F.variant_get("_id", "$", "string").alias("uuid"))
    return samples.distinct(), gone.distinct()


def repaired(bodies: DataFrame) -> DataFrame:
    """``bodies`` (as of ``decoded``) in which JSON that only lenient readers take is made strict.

    Of a key that repeats in an object the last counts; NaN and infinities become their names. Only bodies that are no
    strict JSON pass through Python; what can't be read leniently either stays as it is.
    """
    strict = F.coalesce(F.try_parse_json("body").isNotNull(), F.col("body").isNull())
    names = bodies.columns
    at = names.index("body")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(at).to_pylist():
                try:
                    out.append(json.dumps(json.loads(x, parse_constant=str), ensure_ascii=False))
                except (TypeError, ValueError, RecursionError):
                    out.append(x)
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return bodies.where(strict).unionByName(bodies.where(~strict).mapInArrow(walk, bodies.schema))


def answered(requests: DataFrame, secret: str | None, most: int = MOST_BYTES) -> DataFrame:
    """Requests with ``status`` and ``body``: all guards of the receiver in order.

    ``requests`` has path, token, length (text of the header), encoding and content. 404 for another path, 401 for a token
    that isn't ``secret`` (none is asked for without a secret), 400 for a length that is absent, no number or 0, 413 for
    one that is negative or above ``most``, then the guards of ``decoded``, where only a body said to be gzip is
    decompressed, and 400 for what is no JSON array. ``body`` is null unless the status is 200. Other columns are kept.
    """
    given = F.trim(F.col("length")).try_cast("bigint")
    allowed = F.lit(True) if secret is None else F.coalesce(F.col("token") == secret, F.lit(False))
    first = request_status(F.coalesce("path", F.lit("")), allowed, given, most)
    zipped = F.coalesce(F.lower("encoding") == "gzip", F.lit(False))
    packed = F.coalesce(F.hex(F.substring("content", 1, 2)) == "1F8B", F.lit(False))
    open_ = requests.withColumns({"_first": first, "_wrong": packed & ~zipped | zipped & ~packed})
    read = repaired(decoded(open_.withColumn("content", F.when((F.col("_first") == 200) & ~F.col("_wrong"), F.col("content"))), most=most))
    is_array = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("ARRAY"), F.lit(False))
    status = F.when(F.col("_first") != 200, F.col("_first")).when(F.col("_wrong"), 400).when(F.col("status") != 200, F.col("status")).when(~is_array, 400).otherwise(200)
    kept = [c for c in requests.columns if c not in ("content", "status", "body")]
    return read.select(*kept, status.alias("status"), F.when(status == 200, F.col("body")).alias("body"))


def append_samples(rows: DataFrame, folder: str) -> None:
    """Writes samples as parquet by ``type_stem``, in place of what the folder held; a reader of one type reads one partition."""
    rows.write.mode("overwrite").partitionBy("type_stem").parquet(folder)


def export_lines(rows: DataFrame, folder: str) -> None:
    """Samples as gzipped JSON lines by ``type_stem``, without null fields."""
    rows.write.mode("append").partitionBy("type_stem").option("compression", "gzip").json(folder)


def retained(log: DataFrame, day: str, size: str, most: int = 512 << 10) -> DataFrame:
    """The newest days of a log that together hold at most half of ``most`` bytes, all days if they hold less than ``most``.

    At least the newest day stays. Sizes are added up per day first, so only days are ordered.
    """
    days = log.groupBy(F.col(day).alias("_day")).agg(F.sum(size).alias("_bytes"))
    newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("_day"))
    days = days.withColumns({
        "_upto": F.sum("_bytes").over(newest), "_all": F.sum("_bytes").over(Window.partitionBy(F.lit(0))), "_n": F.row_number().over(newest)
    })
    kept = days.where((F.col("_all") <= most) | (F.col("_upto") <= most // 2) | (F.col("_n") == 1)).select("_day")
    return log.join(kept, F.col(day).eqNullSafe(F.col("_day")), "left_semi")
