"""Operators on small and awkward inputs: nulls, ties, repeats, empty tables, clashing column names; and brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions.masks import READ, Stamps, day_month_order
from cairnflow.functions.scalars import base_url, batch_name, first_bytes, in_zone, positive, type_stem, wait_seconds, with_key
from cairnflow.functions.times import micros, stamp_seconds
from cairnflow.functions.zones import zone_names, zone_tables
from cairnflow.operators import anomalies, chunks, ingest, registry, slices, wire, workouts
from cairnflow.operators.anomalies import features, judged
from cairnflow.operators.arrivals import once
from cairnflow.operators.changes import apply_changes, current_samples, element_changes, packed, unpacked
from cairnflow.operators.grid import regular_grid
from cairnflow.operators.intervals import gaps, periods
from cairnflow.operators.late import Lateness, diverted, period_outcomes
from cairnflow.operators.overlap import within
from cairnflow.operators.ranks import spread_rank
from cairnflow.operators.rolling import trailing_totals
from cairnflow.operators.stamps import normalised
from cairnflow.plans.problems import POSSIBLE
from cairnflow.streaming.late import Ledger
from tests.stamps_by_hand import read, zone_of


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trailing_totals(spark):
    data = [
        ("a", "2026-01-01", 5.0, 9), ("a", "2026-01-01", 5.0, 9), ("a", "2026-01-04", None, 9), ("a", "2026-01-10", float("nan"), 9),
        ("a", "2026-02-20", 1.5, 9), (None, "2026-01-01", 2.0, 9), ("a", None, 7.0, 9), ("a", "2026-01-10", float("inf"), 9),
    ]
    df = spark.createDataFrame(data, "source string, day string, v double, n int").withColumn("day", F.to_date("day"))
    got = trailing_totals(df, ["source"], "day", "v", (7,), 20)
    by = {(r.source, str(r.day)): (r.n, r.t7, r.n7) for r in got.collect()}
    assert by[("a", "2026-01-01")] == (2, 10.0, 2) and by[("a", "2026-01-07")] == (0, 10.0, 3) and by[("a", "2026-01-08")] == (0, 0.0, 1)
    assert by[("a", "2026-01-10")] == (2, 0.0, 3) and by[("a", "2026-02-20")] == (1, 1.5, 1) and by[(None, "2026-01-01")] == (1, 2.0, 1)
    assert len(by) == 12
    assert trailing_totals(df.where("false"), ["source"], "day", "v").count() == 0


def elements(spark, data):
    return spark.createDataFrame(data, "queue_id string, batch_seq bigint, pos int, deleted array<string>, uuid string, value_num double, key string")


def test_changes_by_brute_force(spark):
    rnd = random.Random(4)
    data = []
    for seq in range(900):
        for pos in range(rnd.randint(0, 4)):
            u = rnd.choice("abcdefgh")
            u = u.upper() if rnd.random() < 0.4 else u
            e = ("q", seq, pos, [u, None, u, "never"] if rnd.random() < 0.4 else None, None if rnd.random() < 0.02 else u, float(seq), "clash")
            data += [e] * rnd.choice([1, 1, 1, 3])
    data.append(("q", None, None, [], None, None, "clash"))
    rnd.shuffle(data)
    last = {}
    for q, seq, pos, deleted, uuid, *_ in sorted({(*e[:3], tuple(e[3]) if e[3] is not None else None, *e[4:]) for e in data if e[1] is not None}, key=lambda e: e[1:3]):
        for u in [x.upper() for x in deleted if x] if deleted is not None else [uuid.upper()] if uuid else []:
            last[u] = None if deleted is not None else (seq, pos)
    want = sorted((u, *p) for u, p in last.items() if p)
    state = apply_changes(element_changes(elements(spark, data)), segment=16)
    assert rows(state.select("key", "batch_seq", "pos")) == want
    full = current_samples(elements(spark, data))
    assert sorted((r.uuid, r.value_num) for r in full.collect()) == [(u, float(s)) for u, s, _ in want]
    base = spark.createDataFrame([("zz",), ("never",), ("a",)], "key string")
    assert {r.key for r in apply_changes(element_changes(elements(spark, data)), base).collect()} == {w[0] for w in want} | {"ZZ"}
    assert apply_changes(element_changes(elements(spark, data).where("false"))).count() == 0
    base = spark.createDataFrame([("zz", 5.0, "x"), ("a", 6.0, "y"), (None, 7.0, "z")], "key string, value_num double, extra string")
    got = {r.uuid: (r.value_num, r.batch_seq) for r in current_samples(elements(spark, data), base, 16).collect()}
    assert got["ZZ"] == (5.0, None) and {u: v for u, (v, _) in got.items()} == {u: float(s) for u, s, _ in want} | {"ZZ": 5.0}


def test_packed_keys(spark):
    keys = ["0A1b2c3D-0000-4111-8222-0123456789ab", "x", "", "fifteen letters", "sixteen letters!", "\x01 é ü", "00000000-0000-0000-0000-000000000000"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(unpacked(packed(F.col("k")))).collect()] == [k.upper() for k in keys]
    assert df.select(packed(F.col("k"))).distinct().count() == len(keys) and df.select(F.length(packed(F.col("k")))).first()[0] == 17


def test_intervals_by_brute_force(spark):
    rnd = random.Random(7)
    data = [("s", 10, 10), ("s", 30, 20), ("s", None, 4), (None, 1, 3), (None, 3, 5), (None, 6, 7), ("s", 5, None)]
    for e in ("s", "t"):
        for _ in range(300):
            a = rnd.randint(0, 20000)
            data += [(e, a, a + rnd.randint(-3, 40))] * rnd.choice([1, 1, 2])
    merged = {}
    for e, a, b in sorted((x for x in data if None not in x[1:] and x[1] < x[2]), key=lambda x: (str(x[0]), x[1])):
        own = merged.setdefault(e, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    key = lambda x: (str(x[0]), *x[1:])
    df = spark.createDataFrame([(*x, 1, 2) for x in data], "source string, s bigint, e bigint, _rank int, _entity int")
    want = sorted(((e, *p) for e, own in merged.items() for p in own), key=key)
    assert sorted(map(tuple, periods(df, "source", "s", "e", 500).collect()), key=key) == want
    between = sorted(((e, p[1], q[0]) for e, own in merged.items() for p, q in zip(own, own[1:])), key=key)
    assert sorted(map(tuple, gaps(df, "source", "s", "e", 500).collect()), key=key) == between
    assert gaps(df.where("false"), "source", "s", "e").count() == 0


def test_spread_rank(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", None]), rnd.randint(0, 500)) for _ in range(400)]
    got = spread_rank(spark.createDataFrame(data, "g string, o bigint"), ["g"], "o", 50, "r").collect()
    for g in ("a", None):
        own = sorted((r.o, r.r) for r in got if r.g == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1)) and [o for o, _ in own] == sorted(o for x, o in data if x == g)


def test_grid(spark):
    h = 3600
    data = [("a", 0, 1.0), ("a", 10, 3.0), ("a", 5 * h, None), ("a", 5 * h + 48 * h, 2.0), ("a", 5 * h + 97 * h, 2.0), (None, 7 * h, float("nan")), ("a", None, 3.0)]
    df = spark.createDataFrame([(*x, 9) for x in data], "source string, at bigint, v double, n int")
    got = {(r.source, r.step_start // h): r for r in regular_grid(df, ["source"], "at", "v").collect()}
    assert got[("a", 0)].mean == 2.0 and got[("a", 3)].filled == 2.0 and got[("a", 3)].state == "carried" and got[("a", 4)].state == "missing"
    assert got[("a", 5)].n == 1 and got[("a", 5)].mean is None and ("a", 52) in got and got[("a", 52)].n == 0
    assert ("a", 54) not in got and got[("a", 102)].state == "read" and got[(None, 7)].mean is None
    assert regular_grid(df.where("false"), ["source"], "at", "v").count() == 0


def test_period_outcomes(spark):
    end, us = 86400, 10**6
    data = [("s", 1, (end + 7200) * us, 1.0), ("s", 2, (end + 7200) * us + 1, 2.0), ("s", 3, (end + 259200) * us, None), ("s", 4, (end + 259200) * us + 1, 4.0), ("s", 5, None, 8.0), ("s", None, 1, 1.0), (None, -1, 0, 1.0)]
    df = spark.createDataFrame(data, "source string, at bigint, us bigint, v double")
    rule = Lateness(("source",), "source")
    got = {r.source: r for r in period_outcomes(df, rule, "at", "us", "v").collect()}
    r = got["s"]
    assert (r.n_published, r.n_corrected, r.n_dropped, r.n_closed, r.sum_published, r.sum_closed) == (2, 2, 1, 4, 9.0, 11.0)
    assert (r.published_us, r.closed_us) == ((end + 7200) * us + 1, (end + 259200) * us + 1)
    assert got[None].period_start == -86400 and got[None].n_dropped == 0
    assert [r.v for r in diverted(df, rule, "at", "us", "v", ("source",)).collect()] == [4.0]
    assert period_outcomes(df.where("false"), rule, "at", "us", "v").count() == 0


def late_by_hand(data, scope_of, publish, close, idle, period):
    """Every record judged by a walk over all arrivals: (scope, period) -> [published, corrected, dropped]."""
    heard = {}
    for g, _, a, _ in data:
        if a is not None:
            heard.setdefault(g, []).append(a)
    out = {}
    for g, at, a, kind in data:
        sources = {x[0] for x in data if scope_of(x) == scope_of((g, at, a, kind))}
        k = at // period

        def passed(after, a=a, k=k, sources=sources):
            bound = ((k + 1) * period + after) * 10**6
            if a is None or a <= bound:
                return False
            when = []
            for s in sources:
                next_ = [x for x in heard.get(s, []) if x > bound]
                last = [x for x in heard.get(s, []) if x <= bound]
                silent = max(bound, max(last) + idle * 10**6) if last else bound
                when.append(min([silent, *([min(next_)] if next_ else [])]))
            return a >= max(when)

        row = out.setdefault((scope_of((g, at, a, kind)), k), [0, 0, 0])
        row[2 if passed(close) else 1 if passed(publish) else 0] += 1
    return out


@pytest.mark.parametrize("scope", [("source",), ("kind",), ()])
def test_closing_by_every_source(spark, tmp_path, scope):
    rnd = random.Random(len(scope) + 5)
    data = []
    for i in range(400):
        g, kind, at = rnd.choice("abcde"), rnd.choice("xy"), rnd.randint(0, 900)
        a = None if rnd.random() < 0.03 else at * 10**6 + int(rnd.expovariate(1 / (150 if g != "e" else 900)) * 10**6)
        data.append((g, at, a, kind))
    keys = {("source",): ("source",), ("kind",): ("kind",), (): ("kind",)}[scope]
    rule = Lateness(keys, "source", scope, period_s=100, publish_s=20, close_s=200, idle_s=60)
    schema = "source string, at_s bigint, arrived_us bigint, kind string"
    df = spark.createDataFrame(data, schema).withColumn("value", F.lit(1.0))
    scope_of = {("source",): lambda x: x[0], ("kind",): lambda x: x[3], (): lambda x: None}[scope]
    want = {}
    for (_, k), n in late_by_hand(data, scope_of, 20, 200, 60, 100).items() if keys == scope else ():
        want[_, k] = n
    result = period_outcomes(df, rule, "at_s", "arrived_us", "value").collect()
    if keys == scope:
        assert {(r[0], r.period_start // 100): [r.n_published, r.n_corrected, r.n_dropped] for r in result} == want
    else:
        whole = late_by_hand(data, scope_of, 20, 200, 60, 100)
        by = {}
        for r in result:
            own = by.setdefault((None, r.period_start // 100), [0, 0, 0])
            for i, n in enumerate((r.n_published, r.n_corrected, r.n_dropped)):
                own[i] += n
        assert by == whole
    # the same in micro-batches in order of arrival
    ledger = Ledger(spark, str(tmp_path / "ledger"), rule)
    ordered = sorted(data, key=lambda x: -1 if x[2] is None else x[2])
    for n, part in enumerate((ordered[:150], ordered[150:151], ordered[151:])):
        records = spark.createDataFrame(part, schema).withColumn("value", F.lit(1.0))
        ledger.add(records, n)
        if n == 1:
            ledger.add(records, n)  # a replay
    assert rows(ledger.outcomes()) == sorted(tuple(r) for r in result)
    assert ledger.diverted().count() == sum(r.n_dropped for r in result)


def series(n=400, seed=3):
    rnd = np.random.default_rng(seed)
    v = np.round(60 + 5 * np.sin(np.arange(n) / 15) + rnd.normal(0, 1.0, n), 1)
    bad = {}
    v[50] = 140.0; bad[50] = "spike"  # noqa: E702
    v[90:93] = [25.0, 26.0, 24.5]; bad |= dict.fromkeys(range(90, 93), "spike")  # noqa: E702
    v[150:162] = 61.0; bad |= dict.fromkeys(range(150, 162), "stuck")  # noqa: E702
    v[180:187] = 62.0
    v[200] = -4.0; bad[200] = "impossible"  # noqa: E702
    v[230:239] = [75, 92, 110, 121, 125, 120, 108, 90, 76]
    v[300:] += 30
    return v, bad


@pytest.mark.parametrize("target", [50_000, 40])
def test_verdicts(spark, target, monkeypatch):
    monkeypatch.setattr(anomalies, "chunked", lambda df, s, a, h: chunks.chunked(df, s, a, h, target, 3000))
    v, bad = series()
    data = [(f"u{i:04d}", "s", "heartRate", 1000 + i * 600, float(x), "clash") for i, x in enumerate(v)]
    data += data[:200:3]  # delivered again
    data += [("n1", "s", "heartRate", None, 1.0, ""), ("n2", "s", "heartRate", 5, None, ""), ("n3", None, "other", 5, float("inf"), ""), ("n4", None, None, 5, 1.0, "")]
    df = spark.createDataFrame(data, "uuid string, source string, sample_type string, at bigint, v double, _chunk string")
    got = {r.uuid: r.verdict for r in judged(df, "uuid", "source", "sample_type", "at", "v", POSSIBLE).collect()}
    assert {int(u[1:]): x for u, x in got.items() if x != "credible" and u[0] == "u"} == bad
    assert got["n3"] == "impossible" and got["n4"] == "credible" and "n1" not in got and len(got) == len(v) + 2
    assert judged(df.where("false"), "uuid", "source", "sample_type", "at", "v").count() == 0


def test_features_of_nothing():
    none = np.zeros(0)
    assert len(features(none, none, none.astype(bool))["jump"]) == 0


def test_chunks_hold_their_neighbours(spark):
    rnd = random.Random(2)
    data = [("a", rnd.randint(0, 10**6), i) for i in range(1500)] + [("b", i, i) for i in range(20)] + [(None, i * 50, i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, at bigint, i int")
    got = chunks.chunked(df, ["g"], "at", 10, 100, 5000).collect()
    assert sorted((str(r.g), r.at, r.i) for r in got if r._core) == sorted((str(g), a, i) for g, a, i in data)
    for g in ("a", None):
        order = sorted((a, i) for x, a, i in data if x == g)
        place = {k: p for p, k in enumerate(order)}
        held = {}
        for r in got:
            if r.g == g:
                held.setdefault(r._chunk, set()).add(place[(r.at, r.i)])
        for r in got:
            if r.g == g and r._core:
                p = place[(r.at, r.i)]
                assert set(range(max(0, p - 10), min(len(order), p + 11))) <= held[r._chunk]


def test_stamps_by_hand(spark, sf):
    table = spark.read.parquet(f"{sf}/import_records.parquet")
    want = {}
    for r in table.collect():
        zone = zone_of(r.metadata, r.device_zone)
        want[r.import_id] = (read(r.start_time, r.file_locale, zone), read(r.end_time, r.file_locale, zone))
    assert {r.import_id: (r.start_us, r.end_us) for r in normalised(table).collect()} == want


@pytest.mark.parametrize(
    ("text", "locale", "zone", "want"),
    [
        ("2020-11-16 08:41:00 MST", None, None, "2020-11-16T15:41:00"), ("04/07/2024 2:00 AM", "en_US", "Australia/Sydney", None),
        ("1/2/2021 12:05 AM", "en_US", "UTC", "2021-01-02T00:05:00"), ("1/2/2021 00:05", "en_GB", "UTC", "2021-02-01T00:05:00"),
        ("13/02/2021 10:00", None, "UTC", "2021-02-13T10:00:00"), ("03/02/2021 10:00", "ja_JP", "UTC", None), ("02/02/2021 10:00", "xx", "UTC", "2021-02-02T10:00:00"),
        ("2021-03-14T02:30:00", None, "America/New_York", None), ("2021-11-07T01:30:00", None, "America/New_York", None),
        ("2021-11-07T01:30:00-05:00[America/New_York]", None, "Asia/Tokyo", "2021-11-07T06:30:00"), ("2021-11-07T10:30:00[Asia/Tokyo]", None, None, "2021-11-07T01:30:00"),
        ("601206642.418", None, None, "2020-01-20T09:50:42.418"), ("1578936767335", None, None, "2020-01-13T17:32:47.335"), ("12345", None, None, None),
        ("2024-02-30T10:00:00Z", None, None, None), ("2024-02-29T10:00:00.1234567Z", None, None, "2024-02-29T10:00:00.123456"), ("x" * 5000, None, "UTC", None),
        ("5 Decoy 2021 10:00", None, "UTC", None), ("5 mai 2021 10:00", "fr_FR", "UTC", "2021-05-05T10:00:00"), ("1. März 2021 10:00", "de_DE", "UTC", "2021-03-01T10:00:00"), ("5 juin 2021 10:00", "fr_FR", "UTC", "2021-06-05T10:00:00"),
        ("3 déc. 2021 10:00", "fr_FR", "UTC", "2021-12-03T10:00:00"), ("Sept 3, 2021 10:00", "en_US", "UTC", "2021-09-03T10:00:00"), ("5 jui 2021 10:00", "fr_FR", "UTC", None), ("2017-06-01 10:00:00", None, "Europe/Berlin", "2017-06-01T08:00:00"),
        ("13:00 PM", None, "UTC", None), ("2024-01-01 13:00 PM", None, "UTC", None), ("2024-01-01 10:00 QQT", None, "UTC", None), (None, None, "UTC", None), ("  ", None, "UTC", None),
    ],
)
def test_stamp(text, locale, zone, want):
    zones = np.empty(1, object)
    zones[0] = zone
    us, status = Stamps(zone_tables()).read([text], np.array([day_month_order(locale)]), zones)
    assert (np.datetime64(int(us[0]), "us") if status[0] == READ else None) == (np.datetime64(want, "us") if want else None)


def test_statuses(spark):
    data = [("2021-03-14T02:30:00", None, "America/New_York"), ("2021-03-14T02:30:00", None, None), (" ", "x", None), (None, "1950-01-01 00:00:00", "Asia/Tokyo"), ("2021-01-01T00:00:00Z", "2021-02-30T00:00:00Z", None), ("1600000000", "978307200", None)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "import_id int, start_time string, end_time string, device_zone string").withColumns({"metadata": F.lit(None).cast("string"), "file_locale": F.lit("en_US"), "start_status": F.lit("clash")})
    got = [(r.start_status, r.end_status, r.start_us is None) for r in normalised(df).orderBy("import_id").collect()]
    assert got == [("twice or never", "empty", True), ("no zone", "empty", True), ("empty", "unreadable", True), ("empty", "outside the zone tables", True), ("read", "unreadable", False), ("read", "unreadable", False)]
    assert normalised(df, numbers=(0, 2_000_000_000)).where("import_id = 5").first().end_status == "read"


def test_once_and_times(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), (None, 1, 2), (None, 2, None), ("a", 1, None)], "uuid string, v int, at int")
    assert sorted(map(str, once(df, "uuid", ["v"], "at").collect())) == ["Row(uuid='a', v=1, at=3)", "Row(uuid=None, v=1, at=2)", "Row(uuid=None, v=2, at=None)"]
    s = spark.createDataFrame([("2024-03-10T02:30:00",), ("2024-03-10T02:30:00-05:00",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in s.select(stamp_seconds("t")).collect()] == [1710037800, 1710055800, None, None, None]
    t = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000001' as a, timestamp_ntz'1969-12-31 23:59:59' as b")
    assert tuple(t.select(micros(t, "a"), micros(t, "b")).first()) == (1710037800000001, -1000000)


def test_overlap(spark):
    spans = spark.createDataFrame([(1, "a", 0, 7200), (2, "a", 5, 1), (3, None, 0, 9), (4, "a", None, 9)], "id int, key string, lo bigint, hi bigint")
    points = spark.createDataFrame([("a", 0, 1.0), ("a", 7200, 2.0), ("a", 7201, 3.0), (None, 1, 4.0), ("a", None, 5.0)], "key string, at bigint, value double")
    assert sorted((r.id, r.at) for r in within(spans, points).collect()) == [(1, 0), (1, 7200)]


def test_scalars(spark):
    df = spark.createDataFrame([("100.64.0.7:8787",), (" https://h/x// ",), ("",), ("http://",), (None,)], "u string")
    assert [r[0] for r in df.select(base_url(F.col("u"))).collect()] == ["http://100.64.0.7:8787", "https://h/x", None, None, None]
    df = spark.createDataFrame([("a/b é",), ("",), (None,), ("ok-1_",)], "t string")
    assert [r[0] for r in df.select(type_stem(F.col("t"))).collect()] == ["a_b__", "unknown", "unknown", "ok-1_"]
    one = spark.sql("select 7 seq, 'abcdefghijk' id, map('HKTimeZone', 'x') m, timestamp_ntz'2024-03-10 07:30:00' t")
    r = one.select(
        batch_name(F.col("seq"), F.col("id")), wire.merged_metadata(F.lit(None), F.col("m"), "HKTimeZone"), with_key(F.col("m"), "receivedAt", F.lit("z"))["receivedAt"],
        in_zone(F.col("t"), F.lit("America/New_York")), in_zone(F.col("t"), F.lit("UTC")), in_zone(F.col("t"), F.lit("Asia/Kathmandu")),
        wait_seconds(F.lit(3)), positive(F.lit(0.0)),
    ).first()
    assert tuple(r) == ("batch-000000000007-abcdefgh.json", None, "z", "2024-03-10T03:30:00-04:00", "2024-03-10T07:30:00Z", "2024-03-10T13:15:00+05:45", 240, None)


def test_registry(spark):
    types = registry.registry(spark)
    assert types.count() == 57 and types.select("key").distinct().count() == 57 and types.select("group").distinct().count() == 8
    units = {(a, b): (f, o) for a, b, f, o in registry.UNITS}
    f, o = units[("degF", "°C")]
    assert abs(spark.range(1).select(registry.converted(F.lit(98.6), F.lit(f), F.lit(o), F.lit(1.0))).first()[0] - 37) < 0.01
    labels = spark.createDataFrame([(0, "inBed")], "code int, label string")
    got = registry.labelled(spark.createDataFrame([(0,), (9999,), (None,)], "c int"), labels, "c").collect()
    assert {(r.c, r.label) for r in got} == {(0, "inBed"), (9999, "value_9999"), (None, None)}


def test_workouts(spark):
    spans = [(1, "w", 100, 200, 412.0, 5000.0, 37), (2, "w", 300, 400, 0.0, None, 3001), (3, "w", 500, 450, 9.0, None, None), (4, None, 100, 200, None, 7.0, 37), (5, "w", 600, 700, 50.0, 800.0, 37)]
    ws = spark.createDataFrame(spans, "id int, key string, lo bigint, hi bigint, legacy_energy double, legacy_distance double, code int")
    data = [
        ("w", "heartRate", 100, 90.0), ("w", "heartRate", 200, 110.0), ("w", "heartRate", 201, 999.0), ("w", "stepCount", 150, 5000.0), ("w", "heartRate", 150, None), ("w", "heartRate", 150, float("nan")),
        ("w", "activeEnergyBurned", 120, 0.0), ("w", "activeEnergyBurned", 320, 30.0), ("w", "activeEnergyBurned", 330, 12.5), ("w", "basalEnergyBurned", 620, 0.0), ("w", "basalEnergyBurned", 320, 4.0),
        ("w", "distanceSwimming", 350, 40.0), ("w", "distanceCycling", 350, 0.0), ("w", "distanceWheelchair", 350, 8.0), ("x", "heartRate", 150, 1.0), (None, "heartRate", 150, 1.0), ("w", "heartRate", None, 1.0), ("w", None, 150, 1.0),
    ]
    readings = spark.createDataFrame(data, "key string, sample_type string, at bigint, value double")
    stats = workouts.statistics(ws, readings)
    labels = spark.createDataFrame([(37, "running")], "code int, label string")
    got = {r.id: r for r in workouts.projected(ws, stats, labels).collect()}
    assert len(got) == 5 and (got[1].average_heart_rate, got[1].minimum_heart_rate, got[1].maximum_heart_rate) == (100.0, 90.0, 110.0)
    assert (got[1].total_energy, got[1].basal_energy, got[1].total_distance, got[1].activity) == (412.0, None, 5000.0, "running")  # a sum of 0 is absent
    assert (got[2].total_energy, got[2].basal_energy, got[2].total_distance, got[2].activity) == (42.5, 4.0, 40.0, "activity_3001")
    assert got[3].total_energy == 9.0 and got[3].average_heart_rate is None and got[3].activity is None
    assert got[4].average_heart_rate is None and got[4].total_distance == 7.0 and got[5].basal_energy is None and got[5].total_energy == 50.0
    zero = spark.createDataFrame([(9, "w", 0, 1, 0.0)], "id int, key string, lo bigint, hi bigint, legacy_energy double")
    assert workouts.projected(zero, stats.where("false")).first().total_energy == 0.0  # a legacy total of 0 stays


def test_slices(spark):
    def halved(sizes, most):
        if len(sizes) <= 1 or sum(sizes) + len(sizes) + 1 <= most:
            return [sizes]
        mid = len(sizes) // 2
        return halved(sizes[:mid], most) + halved(sizes[mid:], most)

    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 16, 57):
        sizes = [rnd.randint(1, 60) for _ in range(n)]
        begins = slices.cuts(sizes, 100)
        assert [sizes[a:b] for a, b in zip(begins, [*begins[1:], n])] == (halved(sizes, 100) if n else [])
    rows_ = [("q", 0, i, 30 if i != 5 else 900) for i in range(16)] + [("q", 1, 99, 5), (None, 0, 7, None)]
    df = spark.createDataFrame(rows_, "queue string, page bigint, at bigint, bytes int").withColumn("slice", F.lit("clash"))
    got = slices.sliced(df, "queue", "page", "at", "bytes", 120).collect()
    first = sorted((r for r in got if r.queue == "q" and r.page == 0), key=lambda r: r.slice)
    assert sum(r.n for r in first) == 16 and [r.first for r in first] == sorted(r.first for r in first) and [r.slice for r in first] == list(range(len(first)))
    assert all(r.bytes <= 120 or r.n == 1 for r in got) and [r.anchor for r in first] == [None] * (len(first) - 1) + [15]
    assert {(r.queue, r.bytes, r.anchor) for r in got if r.page == 1 or r.queue is None} == {("q", 7, 99), (None, 2, 7)}
    assert slices.sliced(df.where("false"), "queue", "page", "at", "bytes").count() == 0


def test_batch_files(spark):
    one = spark.sql("select 'id-1' i, 'heartRate' t, timestamp_ntz'2027-05-06 07:08:09.5' c, X'010203' a, parse_json('[{\"uuid\":\"x/y\",\"v\":58.0}]') e")
    text = one.select(wire.batch_json(F.col("i"), F.col("t"), F.col("c"), F.col("a"), F.col("e")).alias("text"))
    assert text.first().text == '{"anchor":"AQID","createdAt":"2027-05-06T07:08:09Z","elements":[{"uuid":"x/y","v":58}],"id":"id-1","typeKey":"heartRate"}'
    files = text.unionByName(spark.createDataFrame([("nope",), (None,), ("{}",), ('{"id":"b","typeKey":"t","createdAt":"2027-01-01T00:00:00Z","elements":[]}',), ('{"id":"b","typeKey":"t","createdAt":"soon","elements":[]}',)], "text string"))
    got = wire.batch_fields(files, "text").select("decoded", "id", "type_key", F.hex("anchor").alias("anchor"), F.col("created_at").cast("string").alias("at"), F.to_json("elements").alias("els")).collect()
    assert [r.decoded for r in got] == [True, False, False, False, True, False]
    assert tuple(got[0])[1:] == ("id-1", "heartRate", "010203", "2027-05-06 07:08:09", '[{"uuid":"x/y","v":58}]') and got[4].anchor is None


def test_metadata(spark):
    df = spark.createDataFrame([(1, '{"a":"x","b":2.5,"c":true,"d":1,"e":[1],"f":null,"g":{"h":1}}', "clash"), (2, None, ""), (3, "{", ""), (4, "[]", "")], "id int, metadata string, kind_ string")
    got = {r.key: (r.kind, r.value) for r in wire.typed(df, "metadata").collect()}
    assert got == {"a": ("string", "x"), "b": ("number", "2.5"), "c": ("bool", "true"), "d": ("number", "1"), "e": ("text", "[1]"), "f": ("text", "null"), "g": ("text", '{"h":1}')}
    m = spark.sql("select map('zone','Asia/Dubai') b, map('HKTimeZone','??','k','v','zone','mine') r, cast(null as map<string,string>) n, map('HKTimeZone','x') z")
    row = m.select(*[wire.merged_metadata(F.col(a), F.col(b), "HKTimeZone") for a, b in (("b", "r"), ("b", "n"), ("n", "z"), ("n", "n"), ("b", "z"))]).first()
    assert tuple(row) == ({"k": "v", "zone": "mine"}, {"zone": "Asia/Dubai"}, None, None, {"zone": "Asia/Dubai"})
    held = spark.sql("select cast(parse_json('{\"on\":true,\"off\":false,\"n\":1,\"s\":\"true\"}') as map<string, variant>) m")
    assert held.select(wire.booleans(F.col("m"))).first()[0] == {"on": True, "off": False}


def test_labels_and_units(spark):
    assert len(registry.ACTIVITIES) == len(set(registry.ACTIVITIES)) == 81 and registry.ACTIVITIES == sorted(registry.ACTIVITIES, key=str.lower)
    hours = spark.createDataFrame(list(enumerate(registry.STAND_HOURS)), "code int, label string")
    got = registry.labelled(spark.createDataFrame([(0,), (1,), (7,), (None,)], "c int"), hours, "c").collect()
    assert {(r.c, r.label) for r in got} == {(0, "stood"), (1, "idle"), (7, "value_7"), (None, None)}
    data = [("timeInDaylight", 120.0, "s", 2.0), ("appleSleepingWristTemperature", 98.6, "degF", 37.0), ("oxygenSaturation", 0.97, None, 97.0), ("heartRateVariabilitySDNN", 0.25, "s", 250.0), ("heartRate", 60.0, "count/min", 60.0), ("nope", 1.0, "s", None), (None, 1.0, None, None), ("heartRate", None, None, None)]
    df = spark.createDataFrame([x[:3] for x in data], "sample_type string, value_num double, unit_label string")
    got = [None if r.measure is None else round(r.measure, 6) for r in registry.measured(df, registry.registry(spark)).collect()]
    assert sorted(got, key=str) == sorted((x[3] for x in data), key=str)
    names = {r.name: r.identifier for r in zone_names(spark).collect()}
    assert names["Europe/Lisbon"] == "Europe/Lisbon" and names["JST"] == "Asia/Tokyo" and "Mars/Phobos" not in names


def test_first_bytes(spark):
    texts = ["", "a" * 400, "é" * 200, "x" + "é" * 200, "€" * 150, "a€" * 100, "🙂" * 90, "xyz" + "🙂" * 90, "short é", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [None if t is None else t.encode()[:300].decode(errors="ignore") for t in texts]
    assert [r[0] for r in df.select(first_bytes(F.col("t"), 300)).collect()] == want


def test_page_elements(spark):
    page = spark.createDataFrame([("q", 7, "x"), ("q", 3, "x"), ("r", 1, "x"), (None, 5, "x"), ("q", None, "x")], "queue string, key bigint, deleted string")
    gone = spark.createDataFrame([("q", "b"), ("q", "a"), ("q", "b"), ("s", "c"), ("q", None), (None, "d")], "queue string, uuid string")
    got = {(r.queue, r.pos): (r.key, r.deleted) for r in ingest.page_elements(page, "key", gone, ["queue"]).collect()}
    assert got == {("q", 0): (3, None), ("q", 1): (7, None), ("q", 2): (None, ["a", "b"]), ("r", 0): (1, None), ("s", 0): (None, ["c"]), (None, 0): (5, None), (None, 1): (None, ["d"])}


def test_first_of(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 0, "w"), ("b", None, "v")], "k string, o int, v string")
    got = {r.k: (r.o, r.v, r._n, r._last) for r in ingest.first_of(df, "k", ["o"], ["v"]).collect()}
    assert got == {"a": (1, "y", 3, 2), "b": (None, "v", 1, None)}


def test_staged_tables_are_cleared(spark, tmp_path):
    from cairnflow.sources import staging

    held = staging.staged(spark.range(5))
    assert held.count() == 5
    path = staging._written[-1][1]
    staging.clear()
    assert not staging._written and not spark._jvm.java.io.File(path).exists()
