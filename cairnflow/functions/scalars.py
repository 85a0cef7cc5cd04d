"""Scalar functions of the pipeline as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_WAIT_S, LONGEST_WAIT_S = 60, 3600


def type_stem(kind: Column) -> Column:
    """A type's name as a partition value: other characters become _, none at all ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_replace(kind, "[^A-Za-z0-9_-]", "_"), F.lit("")), F.lit("unknown"))


def base_url(text: Column) -> Column:
    """A receiver's address: trimmed, http:// by default, without slashes at the end; null without a host."""
    bare = F.trim(text)
    full = F.when(F.instr(bare, "://") == 0, F.concat(F.lit("http://"), bare)).otherwise(bare)
    cut = F.regexp_replace(full, "/+$", "")
    return F.when(F.coalesce(F.regexp_extract(cut, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")) != "", cut)


def endpoint(base: Column, path: str) -> Column:
    return F.concat(base, F.lit(f"/{path}"))


def batch_name(seq: Column, batch_id: Column) -> Column:
    """File name of a queued batch: twelve digits, so that names sort as numbers, and eight characters of its id."""
    return F.format_string("batch-%012d-%s.json", seq.cast("bigint"), F.substring(batch_id, 1, 8))


def wait_seconds(attempt: Column) -> Column:
    """Wait after the n-th failure: doubling from a minute to an hour."""
    return F.least(F.lit(float(LONGEST_WAIT_S)), FIRST_WAIT_S * F.pow(F.lit(2.0), attempt - 1)).cast("bigint")


def in_zone(at: Column, zone: Column) -> Column:
    """A TIMESTAMP_NTZ in UTC as ISO 8601 text in a zone that exists, seconds and offset included; Z for no offset.

    Independent of the session's zone: wall time and offset come from NTZ arithmetic alone.
    """
    wall = F.convert_timezone(F.lit("UTC"), zone, at)
    ahead = wall - at
    minutes = F.extract(F.lit("DAY"), ahead) * 1440 + F.extract(F.lit("HOUR"), ahead) * 60 + F.extract(F.lit("MINUTE"), ahead)
    text = F.replace(F.substring(wall.cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    size = F.abs(minutes)
    offset = F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.concat(text, F.when(minutes == 0, F.lit("Z")).otherwise(offset))


def positive(total: Column) -> Column:
    """A sum that counts only if it is greater than 0, as a statistic of 0 means that there is none."""
    return F.when(total > 0, total)


def request_status(path: Column, token_ok: Column, length: Column, most: int) -> Column:
    """Status of an ingest request by the guards in order: path, token, length."""
    return (
        F.when(path != "/ingest", 404)
        .when(~F.coalesce(token_ok, F.lit(False)), 401)
        .when(F.coalesce(length, F.lit(0)) == 0, 400)
        .when((length > most) | (length < 0), 413)
        .otherwise(200)
    )


def first_bytes(text: Column, n: int) -> Column:
    """The first ``n`` bytes of a text as UTF-8, less a character that they cut."""
    cut = F.substring(F.encode(text, "utf-8"), 1, n)
    tail = F.hex(F.substring(cut, -4, 4))
    # bytes of an unfinished character at the end: a first byte that wants more bytes than follow it
    open_ = F.when(tail.rlike("[CDEF][0-9A-F]$"), 1).when(tail.rlike("[EF][0-9A-F][89AB][0-9A-F]$"), 2).when(tail.rlike("F[0-9A-F]([89AB][0-9A-F]){2}$"), 3).otherwise(0)
    whole = F.length(cut) < n
    return F.decode(F.substring(cut, F.lit(1), F.when(whole, F.length(cut)).otherwise(F.length(cut) - open_)), "utf-8")


def with_key(values: Column, key: str, value: Column) -> Column:
    """A map with a key set, whatever it held before."""
    kept = F.map_filter(F.coalesce(values, F.expr("cast(map() as map<string, string>)")), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value))
