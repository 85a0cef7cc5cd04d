"""A change feed applied to a table as a signed multiset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Batches of a feed whose changes to one key are linked in one task; the links between such segments come after.
SEGMENT = 256

ORDER = ["_seq", "_pos", "_queue", "_kind"]
PAYLOAD = ("sample_type", "start_time", "end_time", "value_num", "value_text", "source")
_UUID = "^[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}$"


def packed(key: Column) -> Column:
    """A key in upper case as bytes, half as long for a UUID. The first byte tells UUIDs from other texts."""
    upper = F.upper(key)
    text = F.concat(F.lit(bytearray(b"\x00")), F.encode(upper, "utf-8"))
    uuid = F.concat(F.lit(bytearray(b"\x01")), F.unhex(F.replace(upper, F.lit("-"), F.lit(""))))
    return F.when(upper.rlike(_UUID), uuid).otherwise(text)


def unpacked(key: Column) -> Column:
    """The text of a packed key."""
    digits = F.hex(key)
    cuts = [F.substring(digits, a, n) for a, n in ((3, 8), (11, 4), (15, 4), (19, 4), (23, 12))]
    return F.when(F.substring(digits, 1, 2) == "01", F.concat_ws("-", *cuts)).otherwise(F.decode(F.substring(key, 2, 1 << 30), "utf-8"))


def element_changes(elements: DataFrame) -> DataFrame:
    """The changes that feed elements denote: key, _seq, _pos, _queue, _kind (1 sample, 0 removal) and sample columns.

    An element with a ``deleted`` list is a removal of each non-null id in it, whatever else it holds; any other element
    with a uuid is a sample. Elements with neither, and null ids, are no changes. Ids are equal whatever their case.
    A null batch_seq or pos comes first in the order. The table is read once.
    """
    payload = [c for c in PAYLOAD if c in elements.columns]
    removed = F.col("deleted").isNotNull()
    ids = F.when(removed, F.col("deleted")).otherwise(F.array("uuid"))
    place = [F.col("batch_seq").alias("_seq"), F.col("pos").alias("_pos"), F.col("queue_id").alias("_queue")]
    flat = elements.select(F.explode(ids).alias("_id"), *place, F.when(removed, 0).otherwise(1).alias("_kind"), *[F.when(~removed, F.col(c)).alias(c) for c in payload])
    return flat.where("_id is not null").select(F.upper("_id").alias("key"), *ORDER, *payload)


def _net(images: DataFrame, within: list[str], payload: bool) -> DataFrame:
    """Images with a positive sum after each contributes plus one, and minus one for the image before it in ``within``."""
    image = F.struct(*ORDER)
    before = F.lag(image).over(Window.partitionBy(*within).orderBy(*ORDER))
    linked = images.select(*within, image.alias("_own"), before.alias("_before"), *["_v"] * payload)
    none = F.lit(None).cast(images.schema["_v"].dataType) if payload else None
    plus = F.struct(F.lit(1).alias("m"), F.col("_own").alias("image"), *[F.col("_v").alias("v")] * payload)
    minus = F.struct(F.lit(-1).alias("m"), F.col("_before").alias("image"), *[none.alias("v")] * payload if payload else [])
    signed = linked.select(*within, F.explode(F.array(plus, minus)).alias("signed")).where("signed.image is not null")
    flat = signed.select(*within, F.col("signed.m").alias("_m"), *[F.col(f"signed.image.{c}").alias(c) for c in ORDER], *[F.col("signed.v").alias("_v")] * payload)
    summed = flat.groupBy(*within, *ORDER).agg(F.sum("_m").alias("_m"), *[F.min("_v").alias("_v")] * payload)
    return summed.where("_m > 0").drop("_m")


def _applied(changes: DataFrame, base: DataFrame | None, segment: int, payload: list[str]) -> DataFrame:
    carried = [F.struct(*payload).alias("_v")] if payload else []
    places = changes.select(packed(F.col("key")).alias("key"), *ORDER, *carried)
    if base is not None:
        none = F.lit(None)
        kinds = dict(changes.dtypes)
        start = [none.cast(kinds[c]).alias(c) for c in ORDER[:3]]
        held = [F.struct(*[(F.col(c) if c in base.columns else none).cast(kinds[c]).alias(c) for c in payload]).alias("_v")] if payload else []
        places = places.unionByName(base.where("key is not null").select(packed(F.col("key")).alias("key"), *start, F.lit(1).alias("_kind"), *held))
    # deliveries of the same change become one before the shuffle already, and rows stay where that shuffle brings them
    whole = F.struct(*ORDER, *["_v"] * bool(payload))
    segments = places.groupBy("key", F.coalesce(F.floor(F.col("_seq") / F.lit(segment)), F.lit(-1)).alias("_segment"))
    flat = segments.agg(F.collect_set(whole).alias("_all")).select("key", "_segment", F.explode("_all").alias("_one"))
    cut = flat.select("key", "_segment", *[F.col(f"_one.{c}").alias(c) for c in ORDER], *[F.col("_one._v").alias("_v")] * bool(payload))
    if payload:
        cut = cut.groupBy("key", "_segment", *ORDER).agg(F.min("_v").alias("_v"))
    left = _net(cut, ["key", "_segment"], bool(payload)).drop("_segment")
    return _net(left, ["key"], bool(payload)).where("_kind = 1")


def apply_changes(changes: DataFrame, base: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """The state after all changes: key and the place (``batch_seq``, ``pos``, ``queue_id``) of the image that is left.

    ``changes`` is as of ``element_changes``; ``base`` holds earlier images with the column ``key`` and counts as having
    been there before any change. Method: a change that is delivered again (same queue, batch and position) is
    one change; each change contributes minus one of the image before it and plus one of its own; the multiplicities
    are summed with the base, and images with a positive sum that aren't removals are the state. Links are made within
    segments of ``segment`` batches first and then between the few images that are left of each key, so the changes to
    one key are never gathered in one task. Keys travel packed, a UUID in 17 bytes.

    Order is batch_seq, then pos, nulls first; arrival plays no part. A removal of an id that never was leaves nothing.
    Two different changes at one place are ordered by queue, a sample after a removal. Null keys of the base are left out.
    """
    state = _applied(changes, base, segment, [])
    return state.select(unpacked(F.col("key")).alias("key"), F.col("_seq").alias("batch_seq"), F.col("_pos").alias("pos"), F.col("_queue").alias("queue_id"))


def current_samples(elements: DataFrame, base: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """The samples that exist after all elements, each with the values of its last version.

    ``base`` is an earlier state with the column ``key`` and any of the sample columns; a row of it that no change touches
    stays as it is, with null queue_id, batch_seq and pos. Values travel with the images, see ``apply_changes``. If a place
    was delivered with different values, the least by value order is taken.
    """
    changes = element_changes(elements)
    payload = [c for c in changes.columns if c not in ("key", *ORDER)]
    state = _applied(changes, base, segment, payload)
    place = [F.col("_queue").alias("queue_id"), F.col("_seq").alias("batch_seq"), F.col("_pos").alias("pos")]
    return state.select(unpacked(F.col("key")).alias("uuid"), *place, *[F.col(f"_v.{c}").alias(c) for c in payload])
