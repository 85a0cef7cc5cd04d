"""Queries of the pipeline's operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import base_url, batch_name, endpoint, first_bytes, in_zone, type_stem, wait_seconds, with_key
from ..functions.times import instant, micros, stamp_seconds
from ..functions.zones import zone_names
from ..operators import ingest, registry, slices, wire, workouts
from ..operators.ranks import spread_rank
from ..sources.landing import answered
from ..sources.tables import table

CUTOFF = "2025-06-01 00:00:00"
FIRST = ["received_at", "line_id"]
#: What the status view says of a type that has brought nothing, and of one that was never asked.
NO_DATA = "No data yet — or Health access not granted (Health app → Sharing)"
WAITING = "Waiting for first sync"


def _zone(metadata: str = "metadata") -> F.Column:
    return F.get_json_object(metadata, "$.timeZone")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed element as a body of one element, as it would be uploaded."""
    el = table(spark, sf_dir, "batch_elements")
    sample = F.to_json(F.struct("uuid", F.col("sample_type").alias("type"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), "source"))
    tomb = F.to_json(F.struct("deleted"))
    body = F.concat(F.lit("["), F.when(F.col("deleted").isNotNull(), tomb).otherwise(sample), F.lit("]"))
    return el.select("element_id", "queue_id", body.alias("body"))


def scan_samples(spark, sf_dir):
    s = table(spark, sf_dir, "samples")
    offset = F.regexp_extract("start_time", r"(Z|[+-]\d\d:\d\d)$", 1)
    return s.select("line_id", "uuid", "sample_type", "start_time", "end_time", "value_num", "value_text", F.col("unit_label").alias("unit"), "source", offset.alias("start_offset"), _zone().alias("zone"))


def base_projection(spark, sf_dir):
    """Samples as they are sent: times in the zone that was recorded, else in the device's; the zone only where it was recorded."""
    names = zone_names(spark)
    recorded = F.broadcast(names.select(F.col("name").alias("_n1"), F.col("identifier").alias("recorded_zone")))
    devices = table(spark, sf_dir, "sources").select(F.col("source").alias("_s"), "device_zone")
    s = table(spark, sf_dir, "samples").select("line_id", "sample_type", "start_time", "end_time", "source", _zone().alias("_z"))
    met = s.join(recorded, F.col("_z") == F.col("_n1"), "left").join(devices, F.col("source") == F.col("_s"), "left")
    zone = F.coalesce("recorded_zone", "device_zone", F.lit("UTC"))
    at = {c: instant(stamp_seconds(c)) for c in ("start_time", "end_time")}
    return met.select("line_id", in_zone(at["start_time"], zone).alias("start"), in_zone(at["end_time"], zone).alias("end"), "recorded_zone")


def enabled_filter(spark, sf_dir):
    off = spark.createDataFrame([("heartRate", False), ("workout", True)], "key string, enabled boolean")
    s = table(spark, sf_dir, "samples").join(F.broadcast(off), F.col("sample_type") == F.col("key"), "left")
    return s.where(F.coalesce("enabled", F.lit(True))).select("line_id", "sample_type")


def registry_scale(spark, sf_dir):
    s = table(spark, sf_dir, "samples").select("line_id", "sample_type", "value_num", "unit_label")
    return registry.measured(s, registry.registry(spark)).select("line_id", F.round("measure", 6).alias("measure"), "unit")


def category_label(spark, sf_dir):
    """Stages to codes and back by a label table, which is input: here a stage's code is its place in the list."""
    labels = spark.createDataFrame(list(enumerate(registry.SLEEP_STAGES)), "code int, label string")
    s = table(spark, sf_dir, "samples").where("sample_type = 'sleepAnalysis'").select("line_id", "value_text")
    known = s.join(F.broadcast(labels), F.col("value_text") == F.col("label"), "left")
    code = F.coalesce("code", F.regexp_extract("value_text", "^value_([0-9]+)$", 1).try_cast("int"))
    return registry.labelled(known.select("line_id", code.alias("code")), labels, "code").select("line_id", "label")


def activity_label(spark, sf_dir):
    """Workouts by activity, and whether the name is one of the known activities."""
    names = spark.createDataFrame([(n,) for n in registry.ACTIVITIES], "name string")
    s = table(spark, sf_dir, "samples").where("sample_type = 'workout'")
    met = s.join(F.broadcast(names), F.col("workout_activity_type") == F.col("name"), "left")
    return met.groupBy("workout_activity_type").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("n_known"))


def kind_guard(spark, sf_dir):
    types = F.broadcast(registry.registry(spark).select(F.col("key").alias("sample_type"), "kind"))
    s = table(spark, sf_dir, "samples").join(types, "sample_type", "left")
    fits = F.coalesce((F.col("kind") == "quantity") == F.col("value_num").isNotNull(), F.lit(False))
    return s.groupBy("sample_type").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("skipped"))


def element_split(spark, sf_dir):
    return ingest.elements(_bodies(spark, sf_dir)).groupBy("queue_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def json_typed(spark, sf_dir):
    """Every entry of the records' metadata with the kind of its value."""
    r = table(spark, sf_dir, "import_records").select("import_id", "metadata")
    return wire.typed(r, "metadata").select("import_id", "key", "kind", "value")


def json_booleans(spark, sf_dir):
    """Entries of the records' metadata that are booleans."""
    r = table(spark, sf_dir, "import_records")
    values = wire.booleans(F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string, variant>"))
    return r.select("import_id", F.explode(values).alias("key", "value"))


def json_encode(spark, sf_dir):
    s = table(spark, sf_dir, "samples")
    wire = F.struct("uuid", F.col("sample_type").alias("type"), F.col("value_num").alias("value"), F.col("unit_label").alias("unit"), F.col("start_time").alias("start"))
    return s.select("line_id", F.to_json(F.parse_json(F.to_json(wire))).alias("json"))


def _metadata_map():
    return F.from_json("metadata", "map<string, string>")


def receivedat_override(spark, sf_dir):
    """Bodies of elements with a receipt of their own, overwritten by the receiver's."""
    el = table(spark, sf_dir, "batch_elements").where("deleted is null")
    sent = F.create_map(F.lit("uuid"), "uuid", F.lit("receivedAt"), F.lit("sent by the device"))
    stamped = with_key(sent, "receivedAt", in_zone(F.col("received_at"), F.lit("UTC")))
    return el.select("element_id", stamped["uuid"].alias("uuid"), stamped["receivedAt"].alias("receivedat"), F.size(stamped).alias("n_keys"))


def metadata_merge(spark, sf_dir):
    """The zone resolved and folded in, the raw zone key dropped even where it can't be resolved."""
    r = _zoned(spark, sf_dir)
    base = F.when(F.col("recorded_zone").isNotNull(), F.create_map(F.lit("zone"), "recorded_zone"))
    m = wire.merged_metadata(base, _metadata_map(), "timeZone")
    return r.select("import_id", m["zone"].alias("zone"), m["HKWasUserEntered"].alias("entered"), F.size(m).alias("n_keys"))


def dedupe_first_wins(spark, sf_dir):
    s = table(spark, sf_dir, "samples").select("uuid", "line_id", "received_at", "sample_type")
    return ingest.first_of(s, "uuid", FIRST, ["sample_type"]).select("uuid", "line_id", "sample_type")


def dedupe_new_only(spark, sf_dir):
    s = table(spark, sf_dir, "samples").select("uuid", "line_id", "received_at")
    cut = F.expr(f"timestamp_ntz'{CUTOFF}'")
    incoming = ingest.first_wins(s.where(F.col("received_at") >= cut), "uuid", FIRST)
    return ingest.new_only(incoming, s.where(F.col("received_at") < cut)).select("uuid", "line_id")


def ingest_counts(spark, sf_dir):
    """Elements received, samples new and tombstones new by queue, from bodies parsed once."""
    split = ingest.elements(_bodies(spark, sf_dir))
    ids = ingest.identified(split).withColumn("_place", F.struct("element_id", "pos"))
    first = ids.groupBy("_sort", "_uuid").agg(F.min("_place").alias("_first")).where("_uuid is not null")
    own = [F.col("_sort").alias("_s"), F.col("_uuid").alias("_u"), F.col("_first")]
    met = ids.join(first.select(*own), (F.col("_sort") == F.col("_s")) & (F.col("_uuid") == F.col("_u")) & (F.col("_place") == F.col("_first")), "left")
    fresh = F.col("_first").isNotNull()
    # a tombstone that names an id twice counts it twice; a sample is new once
    per = met.groupBy("queue_id", "_place").agg(F.max(F.when(fresh & (F.col("_sort") == "sample"), 1).otherwise(0)).alias("_new"), F.count_if(fresh & (F.col("_sort") == "tombstone")).alias("_gone"))
    return per.groupBy("queue_id").agg(F.count(F.lit(1)).alias("received"), F.sum("_new").cast("bigint").alias("new"), F.sum("_gone").cast("bigint").alias("deleted"))


def tombstone_flatten(spark, sf_dir):
    ids = ingest.tombstones_of(ingest.elements(_bodies(spark, sf_dir)))
    return ids.groupBy("uuid").agg(F.min("element_id").alias("first_element"), F.count(F.lit(1)).alias("n"))


def tombstone_new_only(spark, sf_dir):
    el = table(spark, sf_dir, "batch_elements").where("deleted is not null")
    ids = el.select("element_id", "received_at", F.explode("deleted").alias("uuid")).where("uuid is not null")
    cut = F.expr("timestamp_ntz'2026-02-01 00:00:00'")
    first = ingest.first_tombstones(ids.where(F.col("received_at") >= cut), ["element_id"])
    return ingest.new_only(first, ids.where(F.col("received_at") < cut)).select("uuid", "element_id")


def _workouts(spark, sf_dir):
    s = table(spark, sf_dir, "samples").where("sample_type = 'workout'")
    return s.select(
        F.col("line_id").alias("id"), F.col("source").alias("key"), stamp_seconds("start_time").alias("lo"), stamp_seconds("end_time").alias("hi"),
        F.col("total_energy_burned").alias("legacy_energy"), F.col("workout_activity_type").alias("activity"), "duration",
    )


def _workout_statistics(spark, sf_dir):
    types = [workouts.HEART, workouts.ENERGY, workouts.BASAL, *workouts.DISTANCES]
    s = table(spark, sf_dir, "samples").where(F.col("sample_type").isin(types))
    readings = s.select(F.col("source").alias("key"), "sample_type", stamp_seconds("start_time").alias("at"), F.col("value_num").alias("value"))
    return workouts.statistics(_workouts(spark, sf_dir), readings)


def workout_projection(spark, sf_dir):
    """Workouts with totals and the heart rate of the readings within them."""
    full = workouts.projected(_workouts(spark, sf_dir), _workout_statistics(spark, sf_dir))
    names = ("average_heart_rate", "minimum_heart_rate", "maximum_heart_rate", "total_energy", "basal_energy", "total_distance")
    return full.select(F.col("id").alias("line_id"), "activity", "duration", *[F.round(c, 6).alias(c) for c in names])


def interval_stats(spark, sf_dir):
    """Statistics of the readings within each workout by their type."""
    met = _workout_statistics(spark, sf_dir)
    return met.select(F.col("id").alias("line_id"), "sample_type", "n", "lowest", "highest", F.round("average", 6).alias("average"))


def type_status(spark, sf_dir):
    """When each type was last received and last brought something new, and how many samples it has."""
    s = table(spark, sf_dir, "samples").select("uuid", "line_id", "received_at", "sample_type")
    first = ingest.first_of(s, "uuid", FIRST, ["sample_type"])
    delivered = first.groupBy("sample_type").agg(F.max("received_at").alias("last_delivered"), F.max("_last").alias("last_checked"), F.count(F.lit(1)).alias("n_delivered"), F.sum("_n").alias("n_received"))
    return delivered.select("sample_type", micros(delivered, "last_checked").alias("last_checked_us"), micros(delivered, "last_delivered").alias("last_delivered_us"), "n_received", "n_delivered")


def missing_anchor(spark, sf_dir):
    """Enabled types of which nothing was ever synchronised."""
    off = spark.createDataFrame([("workout", False), ("mindfulSession", True)], "key string, enabled boolean")
    wanted = table(spark, sf_dir, "sample_types").join(F.broadcast(off), F.col("sample_type") == F.col("key"), "left").where(F.coalesce("enabled", F.lit(True)))
    kept = table(spark, sf_dir, "batch_elements").select(F.col("sample_type").alias("_t"))
    return wanted.join(kept, F.col("sample_type") == F.col("_t"), "left_anti").select("sample_type")


def ordered_groups(spark, sf_dir):
    types = registry.registry(spark).select("key", "group", "ord")
    seen = table(spark, sf_dir, "samples").select(F.col("sample_type").alias("key"), F.lit("samples").alias("group"), F.lit(1000).alias("ord"))
    both = types.unionByName(seen)
    firsts = both.groupBy("group").agg(F.min("ord").alias("first_seen"), F.size(F.collect_set("key")).alias("n_types"))
    return firsts.orderBy("first_seen")


def keyset_page(spark, sf_dir):
    return ingest.page(table(spark, sf_dir, "samples").select("line_id", "uuid", "sample_type"), "line_id", 1000)


def page_elements(spark, sf_dir):
    """Every page of each queue as elements: its samples in order, then the ids deleted by its tombstones."""
    el = table(spark, sf_dir, "batch_elements").select("queue_id", "element_id", "uuid", "deleted")
    ranked = spread_rank(el, ["queue_id"], "element_id", 100_000, "rank")
    paged = ranked.withColumn("page", F.floor((F.col("rank") - 1) / slices.PAGE))
    added = paged.where("uuid is not null and deleted is null").select("queue_id", "page", "element_id")
    gone = paged.where("deleted is not null").select("queue_id", "page", F.explode("deleted").alias("uuid"))
    return ingest.page_elements(added, "element_id", gone, ["queue_id", "page"]).select("queue_id", "page", "pos", "element_id", F.array_join("deleted", ",").alias("deleted"))


def _pages(spark, sf_dir):
    """Elements of each queue in pages of the incremental scan, with the bytes of their encoding."""
    el = table(spark, sf_dir, "batch_elements")
    body = _bodies(spark, sf_dir).select(F.col("element_id").alias("_e"), (F.octet_length("body") - 2).alias("size"))
    ranked = spread_rank(el.select("queue_id", "element_id"), ["queue_id"], "element_id", 100_000, "rank")
    page = F.floor((F.col("rank") - 1) / slices.PAGE).alias("page")
    return ranked.select("queue_id", "element_id", page).join(body, F.col("element_id") == F.col("_e"))


def chunk(spark, sf_dir):
    """Pages cut to slices of at most 16 KiB, the anchor on the last slice alone."""
    return slices.sliced(_pages(spark, sf_dir), "queue_id", "page", "element_id", "size", 16 << 10)


def batch_codec(spark, sf_dir):
    """Batches written as files and read again: what comes back, and whether it is what went in."""
    el = table(spark, sf_dir, "batch_elements").where("uuid is not null")
    one = F.to_variant_object(F.array(F.struct("uuid", F.col("sample_type").alias("type"))))
    text = wire.batch_json(F.col("queue_id"), F.col("sample_type"), F.col("created_at"), F.encode(F.col("element_id").cast("string"), "utf-8"), one)
    files = el.select("element_id", "uuid", F.col("created_at").alias("_created"), text.alias("text"))
    back = wire.batch_fields(files, "text")
    uuid = F.try_variant_get("elements", "$[0].uuid", "string")
    whole = (F.decode("anchor", "utf-8") == F.col("element_id").cast("string")) & (F.substring(F.col("_created").cast("string"), 1, 19) == F.col("created_at").cast("string"))
    return back.select("element_id", uuid.alias("uuid"), "type_key", F.col("id").alias("queue_id"), (whole & F.col("decoded")).alias("whole"))


def fifo_prefix(spark, sf_dir):
    el = table(spark, sf_dir, "batch_elements")
    failed = F.coalesce((F.col("sample_type") == "heartRate") & (F.col("value_num") > 120), F.lit(False))
    return ingest.prefix_before_failure(el.select("queue_id", "batch_seq", failed.alias("failed")), "queue_id", "batch_seq", "failed")


def backoff(spark, sf_dir):
    """Waits after failures and the next attempts; one that is forced is due at once."""
    el = table(spark, sf_dir, "batch_elements")
    wait = wait_seconds(F.col("pos") + 1)
    at = micros(el, "received_at")
    forced = F.col("batch_seq") % 7 == 0
    rows = el.select("element_id", wait.alias("wait_s"), (at + wait * 1_000_000).alias("next_us"), at.alias("_at"), forced.alias("_forced"))
    due = F.coalesce(F.col("_forced"), F.lit(False)) | (F.col("next_us") <= F.col("_at") + 600_000_000)
    return rows.select("element_id", "wait_s", "next_us", due.alias("due"))


def quarantine(spark, sf_dir):
    """Bodies of the records that the receiver would refuse: none at all, cut off, or no array."""
    r = table(spark, sf_dir, "import_records")
    cut = F.expr("substring(metadata, 1, length(metadata) - 1)")
    body = F.when(F.col("device_zone").isNull(), cut).when(F.col("file_locale") == "en_GB", F.col("metadata")).otherwise(F.concat(F.lit("["), F.col("metadata"), F.lit("]")))
    return ingest.rejected(r.select("import_id", body.alias("body"))).select("import_id", "reason")


def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", type_stem(F.col("applicant")).alias("stem"))


def ts_offset(spark, sf_dir):
    zones = table(spark, sf_dir, "sources").select(F.col("source").alias("_s"), "device_zone")
    s = table(spark, sf_dir, "samples").select("line_id", "source", "received_at").join(zones, F.col("source") == F.col("_s"), "left")
    return s.select("line_id", in_zone(F.col("received_at"), F.coalesce("device_zone", F.lit("UTC"))).alias("received"))


def _zoned(spark, sf_dir):
    """Records with the zone that their metadata name, resolved, and the zone that counts."""
    r = table(spark, sf_dir, "import_records")
    names = zone_names(spark)
    own = F.broadcast(names.select(F.col("name").alias("_n1"), F.col("identifier").alias("recorded_zone")))
    device = F.broadcast(names.select(F.col("name").alias("_n2"), F.col("identifier").alias("_device")))
    met = r.join(own, _zone() == F.col("_n1"), "left").join(device, F.col("device_zone") == F.col("_n2"), "left")
    return met.withColumn("zone", F.coalesce("recorded_zone", "_device", F.lit("UTC"))).drop("_n1", "_n2", "_device")


def zone_provenance(spark, sf_dir):
    return _zoned(spark, sf_dir).select("import_id", "recorded_zone", "zone", F.col("recorded_zone").isNotNull().alias("recorded"))


def url_normalise(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    host = F.concat("source", F.lit(".example:8787"))
    raw = (
        F.when(F.col("n_claims") > 8, F.concat(F.lit("  https://"), host, F.lit("//")))
        .when(F.col("n_claims") > 4, F.concat(host, F.lit("/ ")))
        .when(F.col("n_claims") > 0, F.lit("http://"))
        .otherwise(host)
    )
    base = base_url(raw)
    return d.select("doc_id", base.alias("base"), endpoint(base, "ingest").alias("ingest_url"))


def batch_names(spark, sf_dir):
    el = table(spark, sf_dir, "batch_elements")
    return el.select("element_id", batch_name(F.col("element_id"), F.coalesce("uuid", "queue_id")).alias("name"))


def http_status(spark, sf_dir):
    """Elements as requests of one element each, some of them faulty, answered by the receiver's guards."""
    el = _bodies(spark, sf_dir).join(table(spark, sf_dir, "batch_elements").select(F.col("element_id").alias("_e"), "pos"), F.col("element_id") == F.col("_e"))
    pos = F.col("pos")
    size = F.octet_length("body").cast("string")
    requests = el.select(
        "element_id",
        F.when(pos == 11, "/elsewhere").otherwise("/ingest").alias("path"),
        F.when(pos == 7, "wrong").when(pos != 9, "secret").alias("token"),
        F.when(pos == 3, "x").when(pos == 4, "-5").when(pos == 5, "99999999999").otherwise(size).alias("length"),
        F.when(pos == 2, "gzip").alias("encoding"),
        F.encode(F.when(pos == 6, F.substring("body", 2, 1 << 30)).when(pos == 8, F.expr("substring(body, 2, length(body) - 2)")).otherwise(F.col("body")), "utf-8").alias("content"),
    )
    return answered(requests, "secret").select("element_id", "status", F.col("status").between(200, 299).alias("delivered"))


def status_label(spark, sf_dir):
    """What the status view says of every type of the registry."""
    seen = type_status(spark, sf_dir).select(F.col("sample_type").alias("_t"), "n_delivered")
    types = registry.registry(spark).select("key", "display", "group")
    text = F.when(F.col("n_delivered") > 0, F.concat(F.col("n_delivered").cast("string"), F.lit(" delivered"))).when(F.col("n_delivered").isNotNull(), NO_DATA).otherwise(WAITING)
    return types.join(seen, F.col("key") == F.col("_t"), "left").select("key", "display", "group", text.alias("status"))


def top_recent(spark, sf_dir):
    s = table(spark, sf_dir, "samples")
    return s.select("line_id", "sample_type", "received_at").orderBy(F.desc("received_at"), F.desc("line_id")).limit(200).select("line_id", "sample_type")


def log_tail(spark, sf_dir):
    r = table(spark, sf_dir, "import_records").select("import_id", "metadata").orderBy(F.desc("import_id")).limit(100)
    return r.where(F.try_parse_json("metadata").isNotNull()).select("import_id")


def truncate(spark, sf_dir):
    """Texts cut as the log and the status cut them: a snippet of 300 bytes, the others by characters."""
    d = table(spark, sf_dir, "documents")
    cuts = [F.substring("text", 1, n).alias(f"c{n}") for n in (120, 80, 160)]
    return d.select("doc_id", first_bytes(F.col("text"), 300).alias("b300"), *cuts, F.substring("pub_number", 1, 8).alias("c8"))


def crc32(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"))


QUERIES = {
    "scan_samples": scan_samples, "base_projection": base_projection, "enabled_filter": enabled_filter, "registry_scale": registry_scale, "category_label": category_label, "activity_label": activity_label,
    "kind_guard": kind_guard, "element_split": element_split, "json_typed": json_typed, "json_booleans": json_booleans, "json_encode": json_encode,
    "receivedat_override": receivedat_override, "metadata_merge": metadata_merge, "dedupe_first_wins": dedupe_first_wins,
    "dedupe_new_only": dedupe_new_only, "ingest_counts": ingest_counts, "tombstone_flatten": tombstone_flatten,
    "tombstone_new_only": tombstone_new_only, "workout_projection": workout_projection, "interval_stats": interval_stats,
    "type_status": type_status, "missing_anchor": missing_anchor, "ordered_groups": ordered_groups, "keyset_page": keyset_page,
    "chunk": chunk, "page_elements": page_elements, "batch_codec": batch_codec, "fifo_prefix": fifo_prefix, "backoff": backoff, "quarantine": quarantine, "sanitize": sanitize,
    "ts_offset": ts_offset, "zone_provenance": zone_provenance, "url_normalise": url_normalise, "batch_name": batch_names,
    "http_status": http_status, "status_label": status_label, "top_recent": top_recent, "log_tail": log_tail, "truncate": truncate,
    "crc32": crc32,
}
