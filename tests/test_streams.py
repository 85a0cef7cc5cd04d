"""Landing, restart, re-import, quarantine, offsets and lateness."""

from __future__ import annotations

import gzip
import json
import threading
import time
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairnflow.sources.anchored import anchored
from cairnflow.sources.landing import answered, decoded, export_lines, landed, reloaded, retained, stored_lines, unpacked
from cairnflow.streaming.ingest import Store
from cairnflow.operators.late import Lateness
from cairnflow.streaming.late import Ledger
from cairnflow.sources.settings import Settings
from cairnflow.streaming.supervisor import Supervisor, wait_after
from cairnflow.streaming.upload import send, uploading

BODY = [
    {"uuid": "q-17", "type": "bodyMass", "start": "2024-02-11T06:30:00-03:00", "end": "2024-02-11T06:30:00-03:00", "value": 71.5, "unit": "kg", "source": "scale"},
    {"deleted": ["gone-1", "gone-2"]},
    {"uuid": "q-18", "type": "mindfulSession", "start": "2024-02-11T21:00:00-03:00", "end": "2024-02-11T21:12:00-03:00", "source": "phone", "metadata": {"room": "attic"}},
]


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())
    time.sleep(0.02)


def totals(store):
    return sorted((r.received, r.new, r.deleted) for r in store.deliveries().collect())


def test_restart_and_reimport(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    put(land, "a.json", BODY)
    put(land, "b.json.gz", gzip.compress(json.dumps(BODY).encode()))
    store = Store(spark, str(tmp_path / "store"))
    store.start(str(land), str(tmp_path / "ck"), per_trigger=1).awaitTermination(60)
    assert totals(store) == [(3, 0, 0), (3, 2, 2)]
    put(land, "c.json", [{"uuid": "E-5", "type": "../../etc/passwd"}, 7, {"deleted": None}, {"uuid": 9, "type": "x"}, {"uuid": "", "type": None}])
    store.start(str(land), str(tmp_path / "ck"), per_trigger=1).awaitTermination(60)
    assert (5, 2, 0) in totals(store)
    assert sorted(r.uuid for r in store.samples().collect()) == ["", "E-5", "q-17", "q-18"]
    stems = {r.uuid: r.type_stem for r in store.samples().collect()}
    assert stems["E-5"] == "______etc_passwd" and stems[""] == "unknown"
    again = Store(spark, str(tmp_path / "store"))
    again.start(str(land), str(tmp_path / "ck2"), per_trigger=1).awaitTermination(60)  # a full re-import adds nothing
    assert again.samples().count() == 4 and again.tombstones().count() == 2
    assert totals(again) == [(3, 0, 0), (3, 0, 0), (3, 0, 0), (3, 2, 2), (5, 0, 0), (5, 2, 0)]


def test_replay_of_a_batch(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    put(land, "a.json", BODY)
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        store.load(landed(spark, str(land)), 0)
    assert store.samples().count() == 2 and totals(store) == [(3, 2, 2)]


def test_quarantine_goes_on(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    put(land, "a.json", b"not json")
    put(land, "b.json", {"not": "array"})
    put(land, "c.gz", gzip.compress(json.dumps(BODY).encode())[:40])
    put(land, "d.json", BODY)
    store = Store(spark, str(tmp_path / "store"))
    store.start(str(land), str(tmp_path / "ck"), per_trigger=1).awaitTermination(60)
    assert sorted(r.reason for r in store.quarantine().collect()) == ["400", "array", "json"]
    assert store.samples().count() == 2
    store.start(str(land), str(tmp_path / "ck2")).awaitTermination(60)  # another run has a record of its own
    assert sorted(r.reason for r in store.quarantine().collect()) == ["400", "400", "array", "array", "json", "json"]


def test_repeats_in_tombstones(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    put(land, "a.json", [{"deleted": ["X", "X", 5, None]}, {"deleted": ["X"]}, {"deleted": "X"}, {"deleted": ["Y"], "uuid": "Z", "type": "t"}])
    store = Store(spark, str(tmp_path / "store"))
    store.load(landed(spark, str(land)), 0)
    assert sorted(r.uuid for r in store.tombstones().collect()) == ["X", "X", "Y"]
    assert store.samples().count() == 0


@pytest.mark.parametrize(
    ("content", "status"),
    [(None, 400), (b"", 400), (b"[]", 200), (gzip.compress(b"[]") + gzip.compress(b"x"), 200), (gzip.compress(b"[]")[:-3], 400), (b"\x1f\x8bjunk", 400), (b"\xff\xfe", 400), (gzip.compress(b"0" * 5000), 413), (b"0" * 5000, 413)],
)
def test_unpacked(content, status):
    assert unpacked(content, 4096)[0] == status


def test_decoded_keeps_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"[1]")), (2, None)], "id int, content binary")
    assert sorted((r.id, r.status, r.body) for r in decoded(df).collect()) == [(1, 200, "[1]"), (2, 400, None)]


def test_stored_lines(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"uuid":"a"}\nbroken{\n[1]\n')
    assert stored_lines(spark, str(tmp_path)).count() == 2


def test_anchored(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()

    def write(name, keys, stats=True):
        table = pa.table({"k": pa.array(keys, pa.int64()), "t": [str(k) for k in keys]})
        pq.write_table(table, data / name, row_group_size=50, write_statistics=stats)

    def run():
        q = anchored(spark, str(data), "k", "k bigint, t string").writeStream.format("parquet")
        q.option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = list(range(1, 4001, 2))
    write("a.parquet", first[::-1])
    assert run() == first  # 40 row groups in one run
    write("b.parquet", [4011, 4010, None, 4012, 17], stats=False)
    assert run() == [*first, 4010, 4011, 4012]
    assert run() == [*first, 4010, 4011, 4012]


def test_reloaded(spark, tmp_path):
    lines = ['{"uuid":"a","type":"x"}', '{"uuid":"a"}', '{"deleted":["g","g",4],"receivedAt":"z"}', '{"deleted":null,"uuid":"b"}', "[1]", "broken{", '{"uuid":7}', '{"uuid":""}']
    (tmp_path / "x.ndjson").write_text("\n".join(lines))
    seen, gone = reloaded(stored_lines(spark, str(tmp_path)))
    assert sorted(r.uuid for r in seen.collect()) == ["", "a"] and [r.uuid for r in gone.collect()] == ["g"]


def test_lenient_json(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    put(land, "a.json", b'[{"uuid":"first","uuid":"last","type":true,"value":NaN},{"uuid":"n","type":0},{"uuid":"o","type":["a/b"]},{"uuid":"p","type":2.5}]')
    put(land, "b.json", b'[{"uuid":"broken]')
    store = Store(spark, str(tmp_path / "store"))
    store.load(landed(spark, str(land)), 0)
    assert {r.uuid: r.type_stem for r in store.samples().collect()} == {"last": "True", "n": "unknown", "o": "__a_b__", "p": "2_5"}
    assert [r.reason for r in store.quarantine().collect()] == ["json"]


def test_answered(spark):
    good, zipped = b'[{"uuid":"a"}]', gzip.compress(b"[]")
    cases = [
        ("/else", "s", "14", None, good, 404), ("/ingest", "wrong", "14", None, good, 401), ("/ingest", None, "14", None, good, 401), ("/ingest", "s", None, None, good, 400),
        ("/ingest", "s", "x", None, good, 400), ("/ingest", "s", "0", None, b"", 400), ("/ingest", "s", "-1", None, good, 413), ("/ingest", "s", "99999999999", None, good, 413),
        ("/ingest", "s", "14", None, good, 200), ("/ingest", "s", "22", "GZip", zipped, 200), ("/ingest", "s", "22", None, zipped, 400), ("/ingest", "s", "14", "gzip", good, 400),
        ("/ingest", "s", "4", None, b"{}  ", 400), ("/ingest", "s", "4", None, b"nope", 400), (None, "s", "4", None, good, 404), ("/ingest", "s", "4", None, None, 400),
        ("/ingest", "s", "20", "gzip", gzip.compress(b" " * 9000), 413),
    ]
    df = spark.createDataFrame([(i, *c[:4], bytearray(c[4]) if c[4] is not None else None) for i, c in enumerate(cases)], "n int, path string, token string, length string, encoding string, content binary")
    got = {r.n: r for r in answered(df, "s", 4096).collect()}
    assert [got[i].status for i in range(len(cases))] == [c[5] for c in cases]
    assert all((r.body is None) == (r.status != 200) for r in got.values())
    assert answered(df.where("n in (1, 8)"), None, 4096).where("status = 200").count() == 2


def test_ledger_of_a_stream(spark, tmp_path):
    day, hour = 86400, 3600
    schema = "source string, sample_type string, at_s bigint, arrived_us bigint, value double"
    rows = [
        [("s", "t", 10, (day + 1 * hour) * 10**6, 1.0), ("u", "t", 1, None, None)],
        [("s", "t", 20, (day + 5 * hour) * 10**6, 2.0)],
        [("s", "t", 30, (day + 80 * hour) * 10**6, 4.0), ("s", "t", day + 5, (day + 80 * hour) * 10**6, 8.0)],
    ]
    src = tmp_path / "in"
    ledger = Ledger(spark, str(tmp_path / "ledger"), Lateness(("source", "sample_type"), "source"))
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        ledger.start(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "ck")).awaitTermination(60)
    got = {(r.source, r.period_start): (r.n_published, r.n_corrected, r.n_dropped, r.sum_closed) for r in ledger.outcomes().collect()}
    assert got == {("s", 0): (1, 1, 1, 3.0), ("s", day): (0, 1, 0, 8.0), ("u", 0): (1, 0, 0, None)}
    assert [(r.source, r._arrived) for r in ledger.diverted().collect()] == [("s", (day + 80 * hour) * 10**6)]


def test_retained(spark):
    log = spark.createDataFrame([("2026-01-01", 400), ("2026-01-02", 300), ("2026-01-03", 100)], "day string, size int")
    assert sorted(r.day for r in retained(log, "day", "size", 1000).collect()) == ["2026-01-01", "2026-01-02", "2026-01-03"]
    assert sorted(r.day for r in retained(log, "day", "size", 790).collect()) == ["2026-01-03"]
    assert retained(log, "day", "size", 10).count() == 1


def test_supervisor():
    class Query:
        isActive = False

        def awaitTermination(self, limit):
            return True

    class Slow(Query):
        isActive = True

        def awaitTermination(self, limit):
            return False

        def stop(self):
            stopped.append(1)

    now = [0.0]
    runs, stopped = [], []

    def bad():
        runs.append(1)
        raise KeyError("any exception")

    s = Supervisor({"bad": bad, "good": Query, "slow": Slow}, clock=lambda: now[0])
    assert s.run() == {"bad": "failed", "good": "done", "slow": "timeout"} and stopped == [1]
    assert s.run() == {"bad": "waiting", "good": "done", "slow": "timeout"}
    assert s.run("manual")["bad"] == "failed" and s.due["bad"] == 120
    assert [wait_after(n) for n in (0, 1, 2, 3, 7, 50)] == [0, 60, 120, 240, 3600, 3600]
    assert len(runs) == 2
    now[0] = 1000.0
    assert s.run("refresh")["bad"] == "failed" and s.run("refresh") == {}
    now[0] += 4 * 3600
    assert s.run("refresh")["good"] == "done" and Supervisor({}).run() == {}


def test_upload_stops_at_a_failure(spark, tmp_path):
    got, answers = [], [200, 503]

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            body = gzip.decompress(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((self.headers["Authorization"], json.loads(body)))
            self.send_response(answers.pop(0) if answers else 204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/ingest"
    schema = "batch_seq bigint, body string"
    spark.createDataFrame([(3, "[3]"), (1, "[1]"), (2, "[2]"), (4, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        q = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(uploading(url, "t0"))
        return q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)

    with pytest.raises(Exception, match="503"):
        run()
    assert [b for _, b in got] == [[1], [2]] and got[0][0] == "Bearer t0"
    run()
    assert [b for _, b in got[2:]] == [[1], [2], [3]]
    run()
    server.shutdown()
    assert len(got) == 5 and not send(b"[]", url, timeout_s=1).is_success and send(b"[]", url, timeout_s=1).status == 0


def test_settings(spark, tmp_path):
    s = Settings(spark, str(tmp_path / "settings"))
    assert s.load() == {} and s.enabled(["a"]) == ["a"]
    s.save({"endpoint": "http://h:1", "enabled": {"a": False, "b": True, "c": 0, "d": "false"}})
    s.save({"endpoint": "http://h:2"})
    assert s.load()["endpoint"] == "http://h:2" and s.enabled(["a", "b", "c", "d", "e"]) == ["b", "c", "d", "e"]
    with pytest.raises(ValueError, match="secret"):
        s.save({"apiToken": "x"})


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("u1", 5.0, "heart"), ("u2", None, "sleep")], "uuid string, value double, type_stem string")
    export_lines(rows, str(tmp_path / "out"))
    seen, gone = reloaded(stored_lines(spark, str(tmp_path / "out")))
    assert sorted(r.uuid for r in seen.collect()) == ["u1", "u2"] and gone.count() == 0
    held = spark.read.text(str(tmp_path / "out")).collect()
    assert {(r.value, r.type_stem) for r in held} == {('{"uuid":"u1","value":5.0}', "heart"), ('{"uuid":"u2"}', "sleep")}


def test_crc_vector(spark):
    assert spark.range(1).selectExpr("crc32('123456789') c").first().c == zlib.crc32(b"123456789") == 0xCBF43926
