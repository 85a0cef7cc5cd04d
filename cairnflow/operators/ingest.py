"""Delivered bodies split, deduplicated and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import type_stem


def elements(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The elements of JSON array bodies: the other columns of ``bodies``, ``pos``, ``el`` (VARIANT) and ``kind``.

    ``kind`` is tombstone for an object with the key ``deleted``, whatever its value and whatever else it has; sample for
    any other object; other for what is no object. Bodies that are no JSON array have no elements (see ``rejected``).
    """
    kept = [c for c in bodies.columns if c != body]
    parsed = bodies.select(*kept, F.try_parse_json(body).alias("_v"))
    parsed = parsed.where(F.schema_of_variant("_v").startswith("ARRAY"))
    names = ", ".join(f"b.`{c}`" for c in kept)
    exploded = bodies.sparkSession.sql(
        f"select {names + ', ' if names else ''}e.pos, e.value as el from {{bodies}} b, lateral variant_explode(b._v) e", bodies=parsed
    )
    is_object = F.schema_of_variant("el").startswith("OBJECT")
    has = F.try_variant_get("el", "$.deleted", "variant").isNotNull()
    return exploded.withColumn("kind", F.when(~is_object, "other").when(has, "tombstone").otherwise("sample"))


def rejected(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Bodies that are no JSON array, with ``reason``: json or array. A null body is no JSON."""
    v = F.try_parse_json(body)
    reason = F.when(v.isNull(), "json").when(~F.schema_of_variant(v).startswith("ARRAY"), "array")
    return bodies.withColumn("reason", reason).where("reason is not null")


def type_text(v: F.Column) -> F.Column:
    """A type that is given as JSON as the receiver writes it: a text as it is, a number by its digits, true as ``True``, a
    list or object as compact JSON; null for what counts as nothing (null, false, 0, an empty text, list or object)."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    json = F.to_json(v)
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(json == "true", F.lit("True")))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.when(~json.isin("[]", "{}"), json))
        .when(kind != "VOID", F.when(text.try_cast("double") != 0, json))
    )


def samples_of(split: DataFrame) -> DataFrame:
    """Sample elements with a uuid that is a JSON string (the empty one too): uuid, sample_type, type_stem, el and the rest.

    A type that is no string is read as of ``type_text``; one that counts as nothing is null, and its stem ``unknown``.
    """
    own = F.try_variant_get("el", "$.uuid", "variant")
    uuid = F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get("el", "$.uuid", "string"))
    kind = type_text(F.try_variant_get("el", "$.type", "variant"))
    rows = split.where("kind = 'sample'").withColumns({"uuid": uuid, "sample_type": kind})
    return rows.where("uuid is not null").withColumn("type_stem", type_stem(F.col("sample_type"))).drop("kind")


def tombstones_of(split: DataFrame) -> DataFrame:
    """A row per id of tombstones: uuid and the rest. A list that is none is empty, ids that are no strings are dropped."""
    ids = F.try_variant_get("el", "$.deleted", "array<variant>")
    rows = split.where("kind = 'tombstone'").withColumn("_ids", ids).withColumn("_id", F.explode("_ids"))
    rows = rows.where(F.schema_of_variant("_id") == "STRING")
    return rows.withColumn("uuid", F.variant_get("_id", "$", "string")).drop("_ids", "_id", "el", "kind")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; rows without key are dropped.

    The first place of each key is found by an aggregate that combines before the shuffle; the rows are then kept by a
    semi join on key and place, so wide rows aren't sorted. Rows that tie in everything count as one.
    """
    place = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    least = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct(*place).alias("_place"))
    least = least.groupBy("_key").agg(F.min("_place").alias("_place"))
    same = [F.col(c).eqNullSafe(F.col(f"_place._o{i}")) for i, c in enumerate(order)]
    return df.join(least, [F.col(key) == F.col("_key"), *same], "left_semi").dropDuplicates([key])


def first_of(df: DataFrame, key: str, order: list[str], kept: list[str]) -> DataFrame:
    """The first row of each key by ``order``, in one aggregate: key, order and ``kept`` columns, ``_n`` (rows of the key) and
    ``_last`` (its greatest first order column). For narrow rows; wide ones are kept by ``first_wins``. Rows without key are
    dropped; of rows that tie in all of ``order`` the least counts."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct(*order, *kept).alias("_row"))
    first = rows.groupBy("_key").agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_n"), F.max(F.col("_row")[order[0]]).alias("_last"))
    return first.select(F.col("_key").alias(key), *[F.col("_row")[c].alias(c) for c in (*order, *kept)], "_n", "_last")


def identified(split: DataFrame) -> DataFrame:
    """A row per id of every element, and one without id for an element that has none: the other columns of ``split``, ``_sort``
    (sample, tombstone or other) and ``_uuid``. An element's JSON is read once."""
    own = F.try_variant_get("el", "$.uuid", "variant")
    text = F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get("el", "$.uuid", "string"))
    gone = F.transform(F.try_variant_get("el", "$.deleted", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")))
    ids = F.when(F.col("kind") == "sample", F.array(text)).when(F.col("kind") == "tombstone", gone)
    return split.select(*[c for c in split.columns if c not in ("el", "kind")], F.col("kind").alias("_sort"), F.explode_outer(ids).alias("_uuid"))


def new_only(incoming: DataFrame, stored: DataFrame, key: str = "uuid") -> DataFrame:
    """Rows of ``incoming`` whose key the store doesn't have; null keys are new."""
    seen = stored.select(F.col(key).alias("_seen")).where("_seen is not null").distinct()
    return incoming.join(seen, F.col(key) == F.col("_seen"), "left_anti")


def first_tombstones(ids: DataFrame, order: list[str], key: str = "uuid") -> DataFrame:
    """Tombstone ids of the first element that names them, repeats within that element kept, later elements dropped."""
    first = ids.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])).alias("_place"))
    same = [F.col(c).eqNullSafe(F.col(f"_place._o{i}")) for i, c in enumerate(order)]
    return ids.join(first, [F.col(key) == F.col("_key"), *same], "left_semi")


def prefix_before_failure(batches: DataFrame, queue: str, seq: str, failed: str) -> DataFrame:
    """For each queue: ``delivered`` and ``pending`` rows and ``anchor`` (last delivered number) of a drain in order that
    stops at the first failure. Two aggregates, no sort: what is delivered lies before the least failed number."""
    stop = batches.groupBy(F.col(queue).alias("_q")).agg(F.min(F.when(F.col(failed), F.col(seq))).alias("_stop"))
    rows = batches.join(stop, F.col(queue).eqNullSafe(F.col("_q")))
    done = F.coalesce(F.col(seq) < F.col("_stop"), F.lit(True))
    return rows.groupBy(queue).agg(
        F.count_if(done).alias("delivered"), F.count_if(~done).alias("pending"), F.max(F.when(done, F.col(seq))).alias("anchor")
    )


def page(df: DataFrame, key: str, anchor: int, size: int = 5000) -> DataFrame:
    """The next page of an incremental scan: the ``size`` rows that follow the anchor."""
    return df.where(F.col(key) > anchor).orderBy(key).limit(size)


def page_elements(page_rows: DataFrame, key: str, deletions: DataFrame, group: list[str]) -> DataFrame:
    """The elements that pages give, in order: a sample for each row, then one tombstone with all ids deleted since.

    ``page_rows`` holds ``group`` and ``key`` (a bigint), ``deletions`` ``group`` and ``uuid``. Columns: group, ``pos`` (from 0),
    the key of a sample, ``deleted`` of a tombstone (sorted, each id once). A group without deletions has no tombstone,
    one without samples only that. Pages are bounded (see ``page``), so a group's rows are numbered in one task. Null ids
    and null keys are left out.
    """
    rows = page_rows.where(F.col(key).isNotNull()).select(*group, F.col(key).alias("_key"))
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy("_key")) - 1)
    samples = placed.select(*group, "pos", F.col("_key").alias(key), F.lit(None).cast("array<string>").alias("deleted"))
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    sizes = rows.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    gone = deletions.where("uuid is not null").groupBy(*group).agg(F.array_sort(F.collect_set("uuid")).alias("deleted"))
    met = gone.join(sizes, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left")
    kind = dict(page_rows.dtypes)[key]
    tombs = met.select(*group, F.coalesce("_n", F.lit(0)).alias("pos"), F.lit(None).cast(kind).alias(key), "deleted")
    return samples.unionByName(tombs)
