"""JSON of batches and metadata: encoding, decoding, typing, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = "id string, typeKey string, createdAt string, anchor string, elements variant"


def batch_json(batch_id: Column, type_key: Column, created: Column, anchor: Column, elements: Column) -> Column:
    """A batch as the text of its file: keys sorted, ``created`` (a TIMESTAMP_NTZ in UTC) in ISO 8601 with seconds, the anchor
    (binary) in base64 and left out if it is null, ``elements`` (VARIANT) as they are."""
    stamp = F.concat(F.replace(F.substring(created.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))
    fields = [F.base64(anchor).alias("anchor"), stamp.alias("createdAt"), elements.alias("elements"), batch_id.alias("id"), type_key.alias("typeKey")]
    return F.to_json(F.struct(*fields))


def batch_fields(files: DataFrame, text: str) -> DataFrame:
    """``files`` with the batch that ``text`` encodes: id, type_key, created_at, anchor, elements (VARIANT) and ``decoded``, which
    is false for a text that is no such file (it is to be set aside, not to stop the queue)."""
    v = F.try_parse_json(text)

    def field(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    created = F.replace(F.replace(field("createdAt"), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")
    elements = F.try_variant_get(v, "$.elements", "variant")
    good = F.coalesce(F.schema_of_variant(elements).startswith("ARRAY") & field("id").isNotNull() & field("typeKey").isNotNull() & created.isNotNull(), F.lit(False))
    return files.withColumns({
        "id": field("id"), "type_key": field("typeKey"), "created_at": created, "anchor": F.unbase64(field("anchor")), "elements": elements, "decoded": good,
    })


def typed(df: DataFrame, metadata: str) -> DataFrame:
    """A row per key of the JSON object ``metadata``: the other columns, ``key``, ``kind`` (string, bool, number or text) and
    ``value``. Numbers and booleans stay what they are, also the number 1; lists, objects and null are turned to text."""
    keys = F.json_object_keys(metadata)
    rows = df.withColumn("key", F.explode(keys)).withColumn("_v", F.try_parse_json(metadata))
    raw = F.element_at(F.try_variant_get("_v", "$", "map<string, variant>"), F.col("key"))
    held = rows.withColumn("_x", raw)
    shape = F.schema_of_variant("_x")
    kind = F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "bool").when(shape.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT|FLOAT)"), "number").otherwise("text")
    value = F.when(shape == "STRING", F.try_variant_get("_x", "$", "string")).otherwise(F.to_json("_x"))
    return held.withColumns({"kind": kind, "value": value}).drop("_v", "_x", metadata)


def merged_metadata(base: Column, raw: Column, zone_key: str) -> Column:
    """The map ``base`` with all entries of ``raw`` but the raw zone key, which goes even if it couldn't be resolved; entries of
    ``raw`` count over those of ``base``; null if nothing is left."""
    empty = F.expr("cast(map() as map<string, string>)")
    own = F.map_filter(F.coalesce(raw, empty), lambda k, _: k != zone_key)
    rest = F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    both = F.map_concat(rest, own)
    return F.when(F.size(both) > 0, both)


def booleans(values: Column) -> Column:
    """The entries of a map of VARIANT that are booleans, as of stored settings."""
    own = F.map_filter(values, lambda _, v: F.schema_of_variant(v) == "BOOLEAN")
    return F.transform_values(own, lambda _, v: F.try_variant_get(v, "$", "boolean"))
