"""SQL with the results of the queries, written independently of them, over the same whole tables."""

from __future__ import annotations

from ..functions.zones import ZONE_OF
from ..operators.registry import ACTIVITIES, ROWS, SLEEP_STAGES, UNITS
from . import stamps_sql
from .catalogue import CUTOFF, NO_DATA, WAITING


def _quoted(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


_REGISTRY = ", ".join(f"({i}, {', '.join(_quoted(x) for x in r)})" for i, r in enumerate(ROWS, 1))
_TYPES = f"(VALUES {_REGISTRY}) r(ord, key, display, grp, kind, unit, scale, frequency)"
_UNITS = f"(VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)}, CAST({f!r} AS DOUBLE), CAST({o!r} AS DOUBLE))' for a, b, f, o in UNITS)}) u(a, b, f, o)"
_NAMES = f"(VALUES {', '.join(f'({_quoted(n)})' for n in ACTIVITIES)}) a(name)"
_ABBREVIATED = f"(VALUES {', '.join(f'({_quoted(a)}, {_quoted(z)})' for a, z in ZONE_OF.items())}) b(name, zone)"
_ZONES = f"""zones AS (SELECT name, any_value(zone) AS zone FROM (SELECT name, name AS zone FROM pg_timezone_names() UNION ALL
  SELECT name, zone FROM {_ABBREVIATED} WHERE name NOT IN (SELECT name FROM pg_timezone_names())) GROUP BY 1),
zoned AS (SELECT r.import_id, r.metadata, o.zone AS own, coalesce(o.zone, d.zone, 'UTC') AS zone FROM import_records r
  LEFT JOIN zones o ON o.name = (r.metadata ->> '$.timeZone') LEFT JOIN zones d ON d.name = r.device_zone)"""
_ISO = "strftime({w}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {m} = 0 THEN 'Z' ELSE (CASE WHEN {m} < 0 THEN '-' ELSE '+' END) || lpad(CAST(abs({m}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs({m}) % 60 AS VARCHAR), 2, '0') END"
_STAGES = f"(VALUES {', '.join(f'({i}, {_quoted(s)})' for i, s in enumerate(SLEEP_STAGES))}) l(code, label)"
_S = "CAST(epoch(CAST({} AS TIMESTAMPTZ)) AS BIGINT)"
_START, _END = _S.format("start_time"), _S.format("end_time")

_ACC = f"""acc AS (
  SELECT s.uuid, s.source, s.sample_type, CAST(substr(s.start_time, 1, 10) AS DATE) AS d, s.value_num AS v,
         row_number() OVER (PARTITION BY s.uuid ORDER BY s.received_at, s.line_id) AS k
  FROM samples s JOIN sample_types t USING (sample_type) WHERE t.shape = 'accumulated'),
daily AS (SELECT source, sample_type, d, count(*) AS n, sum(v) AS v FROM acc WHERE k = 1 GROUP BY ALL),
ahead AS (SELECT *, lead(d) OVER (PARTITION BY source, sample_type ORDER BY d) AS nd FROM daily),
grid AS (
  SELECT source, sample_type, CAST(unnest(generate_series(d, CASE WHEN nd - d - 1 BETWEEN 1 AND 20 THEN nd - 1 ELSE d END, INTERVAL 1 DAY)) AS DATE) AS d FROM ahead),
full_days AS (SELECT g.source, g.sample_type, g.d, coalesce(a.n, 0) AS n, coalesce(a.v, 0) AS v FROM grid g LEFT JOIN daily a USING (source, sample_type, d)),
totals AS (
  SELECT source, sample_type, d, n,
    sum(v) OVER w7 AS t7, sum(n) OVER w7 AS n7, sum(v) OVER w30 AS t30, sum(n) OVER w30 AS n30
  FROM full_days
  WINDOW w7 AS (PARTITION BY source, sample_type ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY source, sample_type ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))"""

_CHANGES = """changes AS (
  SELECT DISTINCT upper(uuid) AS u, queue_id, batch_seq, pos, 1 AS kind FROM batch_elements WHERE deleted IS NULL AND uuid IS NOT NULL
  UNION
  SELECT upper(x), queue_id, batch_seq, pos, 0 FROM (SELECT unnest(deleted) AS x, queue_id, batch_seq, pos FROM batch_elements) WHERE x IS NOT NULL),
latest AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY batch_seq DESC, pos DESC, queue_id DESC, kind DESC) AS k FROM changes)"""

_SLEEP = f"""spans AS (SELECT DISTINCT source, {_START} AS s, {_END} AS e FROM samples WHERE sample_type = 'sleepAnalysis'),
ordered AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE e > s),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM ordered),
merged AS (SELECT source, p, min(s) AS s, max(e) AS e FROM numbered GROUP BY ALL)"""

_ARRIVED = f"""arr AS (
  SELECT s.uuid, any_value(s.source) AS source, any_value(s.sample_type) AS sample_type, any_value({_S.format('s.start_time')}) AS sec, any_value(s.value_num) AS v,
         CAST(epoch_us(min(s.received_at)) AS BIGINT) AS us
  FROM samples s JOIN sample_types t USING (sample_type) WHERE t.shape IN ('sampled', 'daily', 'accumulated') GROUP BY s.uuid),
placed AS (SELECT *, CAST(floor(sec / 86400) AS BIGINT) AS d FROM arr),
judged AS (SELECT *, us <= (d + 1) * 86400000000 + 7200000000 AS pub, us <= (d + 1) * 86400000000 + 259200000000 AS opn FROM placed)"""

_PASSED = f"""{_ARRIVED},
asked AS (SELECT DISTINCT source, d FROM placed),
bounds AS (SELECT source, d, (d + 1) * 86400000000 + 7200000000 AS pb, (d + 1) * 86400000000 + 259200000000 AS cb FROM asked),
p1 AS (SELECT b.*, n.us AS pn FROM bounds b ASOF LEFT JOIN arr n ON b.source = n.source AND b.pb < n.us),
p2 AS (SELECT b.*, l.us AS pl FROM p1 b ASOF LEFT JOIN arr l ON b.source = l.source AND b.pb >= l.us),
p3 AS (SELECT b.*, n.us AS cn FROM p2 b ASOF LEFT JOIN arr n ON b.source = n.source AND b.cb < n.us),
p4 AS (SELECT b.*, l.us AS cl FROM p3 b ASOF LEFT JOIN arr l ON b.source = l.source AND b.cb >= l.us),
times AS (SELECT source, d, cb, least(coalesce(pn, greatest(pb, coalesce(pl + 21600000000, pb))), greatest(pb, coalesce(pl + 21600000000, pb))) AS published_us,
  least(coalesce(cn, greatest(cb, coalesce(cl + 21600000000, cb))), greatest(cb, coalesce(cl + 21600000000, cb))) AS closed_us FROM p4)"""

_HOURS = f"""readings AS (
  SELECT s.uuid, any_value(s.source) AS source, any_value(s.sample_type) AS sample_type, any_value(s.value_num) AS v,
         any_value(CAST(floor({_S.format('s.start_time')} / 3600) AS BIGINT)) AS h
  FROM samples s JOIN sample_types t USING (sample_type) WHERE t.shape = 'sampled' AND s.value_num IS NOT NULL GROUP BY s.uuid),
hours AS (SELECT source, sample_type, h, count(*) AS n, avg(v) AS m FROM readings GROUP BY ALL),
ahead AS (SELECT *, lead(h) OVER (PARTITION BY source, sample_type ORDER BY h) AS nh FROM hours)"""

_ELEMENTS = """els AS (SELECT element_id, queue_id, uuid, deleted, received_at FROM batch_elements),
ids AS (SELECT element_id, queue_id, received_at, x FROM (SELECT element_id, queue_id, received_at, unnest(deleted) AS x FROM els) WHERE x IS NOT NULL)"""

SQL = {
    "p1_totals": f"WITH {_ACC} SELECT source, sample_type, d AS local_day, CAST(n AS BIGINT) AS n, CAST(t7 AS DOUBLE) AS t7, CAST(n7 AS BIGINT) AS n7, CAST(t7 AS DOUBLE) / 7 AS avg7, CAST(t30 AS DOUBLE) AS t30, CAST(n30 AS BIGINT) AS n30, CAST(t30 AS DOUBLE) / 30 AS avg30 FROM totals",
    "p1_found": f"WITH {_ACC} SELECT source, sample_type, CAST(d AS VARCHAR) AS local_day FROM totals WHERE 60 * t7 < 7 * t30",
    "p2_found": f"WITH {_CHANGES} SELECT u AS uuid, batch_seq, pos FROM latest WHERE k = 1 AND kind = 1",
    "p2_state": f"""WITH {_CHANGES}
      SELECT DISTINCT l.u AS uuid, l.queue_id, l.batch_seq, l.pos, b.sample_type, b.start_time, b.end_time, b.value_num, b.value_text, b.source
      FROM latest l JOIN batch_elements b ON upper(b.uuid) = l.u AND b.queue_id = l.queue_id AND b.batch_seq = l.batch_seq AND b.pos = l.pos AND b.deleted IS NULL
      WHERE l.k = 1 AND l.kind = 1""",
    "p3_found": f"""WITH {_SLEEP} SELECT source, gap_start_s, gap_end_s FROM (
      SELECT source, e AS gap_start_s, lead(s) OVER (PARTITION BY source ORDER BY s) AS gap_end_s FROM merged) WHERE gap_end_s - gap_start_s < 43200""",
    "p3_periods": f"WITH {_SLEEP} SELECT source, s AS period_start_s, e AS period_end_s FROM merged",
    "p4_found": stamps_sql.FOUND,
    "p5_found": f"""WITH {_ARRIVED}, days AS (SELECT source, sample_type, d, count(*) FILTER (opn AND NOT pub) AS c, count(*) FILTER (NOT opn) AS x FROM judged GROUP BY ALL)
      SELECT source, sample_type, CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS event_day, 'corrected' AS outcome FROM days WHERE c > 0
      UNION ALL SELECT source, sample_type, CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR), 'dropped' FROM days WHERE x > 0""",
    "p5_totals": f"""WITH {_PASSED}
      SELECT j.source, sample_type, j.d * 86400 AS period_start, count(*) FILTER (pub) AS n_published, count(*) FILTER (opn) AS n_closed, count(*) FILTER (opn AND NOT pub) AS n_corrected,
        count(*) FILTER (NOT opn) AS n_dropped, round(sum(v) FILTER (pub), 6) AS sum_published, round(sum(v) FILTER (opn), 6) AS sum_closed, any_value(published_us) AS published_us, any_value(closed_us) AS closed_us
      FROM judged j JOIN times t ON j.source = t.source AND j.d = t.d GROUP BY ALL""",
    "p5_diverted": f"WITH {_ARRIVED} SELECT uuid, source, sample_type, d * 86400 AS period_start, us AS arrived_us FROM judged WHERE NOT opn",
    "p5_joint": f"""WITH {_PASSED},
      pairs AS (SELECT DISTINCT p.sample_type, p.d, m.source FROM placed p JOIN (SELECT DISTINCT sample_type, source FROM placed) m USING (sample_type)),
      b AS (SELECT *, (d + 1) * 86400000000 + 259200000000 AS cb FROM pairs),
      q1 AS (SELECT b.*, n.us AS cn FROM b ASOF LEFT JOIN arr n ON b.source = n.source AND b.cb < n.us),
      q2 AS (SELECT q1.*, l.us AS cl FROM q1 ASOF LEFT JOIN arr l ON q1.source = l.source AND q1.cb >= l.us),
      c AS (SELECT sample_type, d, max(least(coalesce(cn, greatest(cb, coalesce(cl + 21600000000, cb))), greatest(cb, coalesce(cl + 21600000000, cb)))) AS closed_us FROM q2 GROUP BY ALL)
      SELECT p.sample_type, p.d * 86400 AS period_start, count(*) FILTER (NOT (us > (p.d + 1) * 86400000000 + 259200000000 AND us >= closed_us)) AS n_closed,
        count(*) FILTER (us > (p.d + 1) * 86400000000 + 259200000000 AND us >= closed_us) AS n_dropped, any_value(closed_us) AS closed_us
      FROM placed p JOIN c ON p.sample_type = c.sample_type AND p.d = c.d GROUP BY ALL""",
    "p7_found": f"""WITH {_HOURS} SELECT source, sample_type, hour_start_s FROM (
      SELECT source, sample_type, unnest(generate_series((h + 1) * 3600, (nh - 1) * 3600, 3600)) AS hour_start_s FROM ahead WHERE nh - h BETWEEN 2 AND 48)""",
    "scan_samples": "SELECT line_id, uuid, sample_type, start_time, end_time, value_num, value_text, unit_label AS unit, source, regexp_extract(start_time, '(Z|[+-]\\d\\d:\\d\\d)$', 1) AS start_offset, metadata ->> '$.timeZone' AS zone FROM samples",
    "base_projection": f"""WITH {_ZONES}, z AS (SELECT s.line_id, o.zone AS own, coalesce(o.zone, d.device_zone, 'UTC') AS zone, timezone('UTC', to_timestamp({_START})) AS a, timezone('UTC', to_timestamp({_END})) AS b
        FROM samples s LEFT JOIN zones o ON o.name = (s.metadata ->> '$.timeZone') LEFT JOIN sources d USING (source)),
      l AS (SELECT line_id, own, a, b, timezone(zone, timezone('UTC', a)) AS wa, timezone(zone, timezone('UTC', b)) AS wb FROM z),
      o AS (SELECT *, CAST((epoch_us(wa) - epoch_us(a)) // 60000000 AS BIGINT) AS ma, CAST((epoch_us(wb) - epoch_us(b)) // 60000000 AS BIGINT) AS mb FROM l)
      SELECT line_id, {_ISO.format(w='wa', m='ma')} AS start, {_ISO.format(w='wb', m='mb')} AS "end", own AS recorded_zone FROM o""",
    "page_elements": """WITH e AS (SELECT *, (row_number() OVER (PARTITION BY queue_id ORDER BY element_id) - 1) // 5000 AS page FROM batch_elements),
      a AS (SELECT queue_id, page, element_id FROM e WHERE uuid IS NOT NULL AND deleted IS NULL),
      g AS (SELECT queue_id, page, array_to_string(list_sort(list(DISTINCT x)), ',') AS deleted FROM (SELECT queue_id, page, unnest(deleted) AS x FROM e) WHERE x IS NOT NULL GROUP BY ALL),
      n AS (SELECT queue_id, page, count(*) AS n FROM a GROUP BY ALL)
      SELECT queue_id, CAST(page AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY queue_id, page ORDER BY element_id) - 1 AS INTEGER) AS pos, element_id, CAST(NULL AS VARCHAR) AS deleted FROM a
      UNION ALL SELECT queue_id, CAST(g.page AS BIGINT), CAST(coalesce(n.n, 0) AS INTEGER), NULL, g.deleted FROM g LEFT JOIN n USING (queue_id, page)""",
    "enabled_filter": "SELECT line_id, sample_type FROM samples WHERE sample_type IS DISTINCT FROM 'heartRate'",
    "registry_scale": f"SELECT line_id, round((value_num * coalesce(u.f, 1) + coalesce(u.o, 0)) * r.scale, 6) AS measure, r.unit FROM samples LEFT JOIN {_TYPES} ON sample_type = r.key LEFT JOIN {_UNITS} ON u.a = unit_label AND u.b = r.unit",
    "category_label": "SELECT line_id, value_text AS label FROM samples WHERE sample_type = 'sleepAnalysis'",
    "kind_guard": f"""WITH f AS (SELECT sample_type, coalesce((r.kind = 'quantity') = (value_num IS NOT NULL), false) AS ok FROM samples LEFT JOIN {_TYPES} ON sample_type = r.key)
      SELECT sample_type, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS skipped FROM f GROUP BY 1""",
    "element_split": "SELECT queue_id, CASE WHEN deleted IS NOT NULL THEN 'tombstone' ELSE 'sample' END AS kind, count(*) AS n FROM batch_elements GROUP BY ALL",
    "json_typed": """SELECT import_id, j.key AS key, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'BIGINT' THEN 'number' WHEN 'UBIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE 'text' END AS kind, j.atom ->> '$' AS value
      FROM import_records, json_each(metadata) j""",
    "json_encode": """SELECT line_id, '{"start":"' || start_time || '","type":"' || sample_type || '"' || CASE WHEN unit_label IS NULL THEN '' ELSE ',"unit":"' || unit_label || '"' END
      || ',"uuid":"' || uuid || '"' || CASE WHEN value_num IS NULL THEN '' WHEN value_num = floor(value_num) THEN ',"value":' || CAST(CAST(value_num AS BIGINT) AS VARCHAR)
      ELSE ',"value":' || CAST(value_num AS VARCHAR) END || '}' AS json FROM samples""",
    "receivedat_override": "SELECT element_id, uuid, strftime(received_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS receivedat, CAST(2 AS INTEGER) AS n_keys FROM batch_elements WHERE deleted IS NULL",
    "metadata_merge": f"""WITH {_ZONES}, k AS (SELECT import_id, own, metadata ->> '$.HKWasUserEntered' AS entered FROM zoned)
      SELECT import_id, own AS zone, entered, CAST(nullif(CASE WHEN own IS NULL THEN 0 ELSE 1 END + CASE WHEN entered IS NULL THEN 0 ELSE 1 END, 0) AS INTEGER) AS n_keys FROM k""",
    "dedupe_first_wins": "SELECT uuid, line_id, sample_type FROM samples QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY received_at, line_id) = 1",
    "dedupe_new_only": f"""SELECT uuid, line_id FROM (SELECT * FROM samples WHERE received_at >= TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY received_at, line_id) = 1)
      WHERE uuid NOT IN (SELECT uuid FROM samples WHERE received_at < TIMESTAMP '{CUTOFF}')""",
    "ingest_counts": f"""WITH {_ELEMENTS},
      new AS (SELECT queue_id, count(*) AS n FROM (SELECT * FROM els WHERE deleted IS NULL AND uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY element_id) = 1) GROUP BY 1),
      gone AS (SELECT queue_id, count(*) AS n FROM (SELECT * FROM ids QUALIFY rank() OVER (PARTITION BY x ORDER BY element_id) = 1) GROUP BY 1)
      SELECT e.queue_id, count(*) AS received, coalesce(any_value(new.n), 0) AS new, coalesce(any_value(gone.n), 0) AS deleted
      FROM els e LEFT JOIN new USING (queue_id) LEFT JOIN gone USING (queue_id) GROUP BY 1""",
    "tombstone_flatten": f"WITH {_ELEMENTS} SELECT x AS uuid, min(element_id) AS first_element, count(*) AS n FROM ids GROUP BY 1",
    "tombstone_new_only": f"""WITH {_ELEMENTS} SELECT x AS uuid, element_id FROM (SELECT * FROM ids WHERE received_at >= TIMESTAMP '2026-02-01' QUALIFY rank() OVER (PARTITION BY x ORDER BY element_id) = 1)
      WHERE x NOT IN (SELECT x FROM ids WHERE received_at < TIMESTAMP '2026-02-01')""",
    "interval_stats": f"""WITH w AS (SELECT line_id, source, {_START} AS lo, {_END} AS hi FROM samples WHERE sample_type = 'workout'),
      h AS (SELECT source, {_START} AS sec, value_num AS v FROM samples WHERE sample_type = 'heartRate' AND value_num IS NOT NULL)
      SELECT line_id, 'heartRate' AS sample_type, count(*) AS n, min(v) AS lowest, max(v) AS highest, round(avg(v), 6) AS average FROM w JOIN h ON w.source = h.source AND sec BETWEEN lo AND hi GROUP BY 1""",
    "type_status": """SELECT sample_type, CAST(epoch_us(max(received_at)) AS BIGINT) AS last_checked_us, CAST(epoch_us(max(received_at) FILTER (k = 1)) AS BIGINT) AS last_delivered_us,
      count(*) AS n_received, count(*) FILTER (k = 1) AS n_delivered
      FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY received_at, line_id) AS k FROM samples) GROUP BY 1""",
    "missing_anchor": "SELECT sample_type FROM sample_types WHERE sample_type <> 'workout' AND sample_type NOT IN (SELECT sample_type FROM batch_elements WHERE sample_type IS NOT NULL)",
    "ordered_groups": f"""SELECT grp AS "group", min(ord) AS first_seen, CAST(count(DISTINCT key) AS INTEGER) AS n_types FROM (
      SELECT grp, ord, key FROM {_TYPES} UNION ALL SELECT 'samples', 1000, sample_type FROM samples) GROUP BY 1""",
    "keyset_page": "SELECT line_id, uuid, sample_type FROM samples WHERE line_id > 1000 ORDER BY line_id LIMIT 5000",
    "chunk": """WITH RECURSIVE e AS (SELECT queue_id, element_id, octet_length(encode(CASE WHEN deleted IS NOT NULL
          THEN '{"deleted":[' || array_to_string(list_transform(deleted, lambda x: coalesce('"' || x || '"', 'null')), ',') || ']}'
          ELSE '{' || array_to_string(list_filter([CASE WHEN uuid IS NOT NULL THEN '"uuid":"' || uuid || '"' END, CASE WHEN sample_type IS NOT NULL THEN '"type":"' || sample_type || '"' END,
            CASE WHEN start_time IS NOT NULL THEN '"start":"' || start_time || '"' END, CASE WHEN end_time IS NOT NULL THEN '"end":"' || end_time || '"' END, CASE WHEN source IS NOT NULL THEN '"source":"' || source || '"' END], lambda x: x IS NOT NULL), ',') || '}' END)) AS size,
          row_number() OVER (PARTITION BY queue_id ORDER BY element_id) - 1 AS r FROM batch_elements),
      p AS (SELECT queue_id, r // 5000 AS page, r % 5000 AS i, element_id, sum(size) OVER (PARTITION BY queue_id, r // 5000 ORDER BY r) AS upto, size FROM e),
      s AS (SELECT queue_id, page, CAST(0 AS BIGINT) AS lo, count(*) AS hi, true AS open FROM p GROUP BY ALL
        UNION ALL
        SELECT queue_id, page, x.lo, x.hi, true FROM (
          SELECT s.queue_id, s.page, s.lo, s.hi, unnest([{'lo': s.lo, 'hi': s.lo + (s.hi - s.lo) // 2}, {'lo': s.lo + (s.hi - s.lo) // 2, 'hi': s.hi}]) AS x
          FROM s JOIN p a ON a.queue_id = s.queue_id AND a.page = s.page AND a.i = s.lo JOIN p b ON b.queue_id = s.queue_id AND b.page = s.page AND b.i = s.hi - 1
          WHERE s.hi - s.lo > 1 AND b.upto - a.upto + a.size + s.hi - s.lo + 1 > 16384)),
      f AS (SELECT s.queue_id, s.page, s.lo, s.hi, b.upto - a.upto + a.size + s.hi - s.lo + 1 AS bytes, a.element_id AS first, b.element_id AS last
        FROM s JOIN p a ON a.queue_id = s.queue_id AND a.page = s.page AND a.i = s.lo JOIN p b ON b.queue_id = s.queue_id AND b.page = s.page AND b.i = s.hi - 1
        WHERE NOT (s.hi - s.lo > 1 AND b.upto - a.upto + a.size + s.hi - s.lo + 1 > 16384))
      SELECT queue_id, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY queue_id, page ORDER BY lo) - 1 AS slice, hi - lo AS n, CAST(bytes AS BIGINT) AS bytes, first, last,
        CASE WHEN hi = max(hi) OVER (PARTITION BY queue_id, page) THEN last END AS anchor FROM f""",
    "fifo_prefix": """WITH f AS (SELECT queue_id, batch_seq, min(batch_seq) FILTER (sample_type = 'heartRate' AND value_num > 120) OVER (PARTITION BY queue_id) AS stop FROM batch_elements),
      g AS (SELECT *, stop IS NULL OR batch_seq < stop AS done FROM f)
      SELECT queue_id, count(*) FILTER (done) AS delivered, count(*) FILTER (NOT done) AS pending, max(batch_seq) FILTER (done) AS anchor FROM g GROUP BY 1""",
    "backoff": """WITH b AS (SELECT element_id, batch_seq, CAST(least(3600, 60 * pow(2, pos)) AS BIGINT) AS wait_s, CAST(epoch_us(received_at) AS BIGINT) AS us FROM batch_elements)
      SELECT element_id, wait_s, us + wait_s * 1000000 AS next_us, coalesce(batch_seq % 7 = 0, false) OR wait_s <= 600 AS due FROM b""",
    "quarantine": """SELECT import_id, CASE WHEN metadata IS NULL OR device_zone IS NULL THEN 'json' ELSE 'array' END AS reason FROM import_records
      WHERE metadata IS NULL OR device_zone IS NULL OR file_locale = 'en_GB'""",
    "sanitize": "SELECT doc_id, CASE WHEN coalesce(applicant, '') = '' THEN 'unknown' ELSE regexp_replace(applicant, '[^A-Za-z0-9_-]', '_', 'g') END AS stem FROM documents",
    "ts_offset": """WITH z AS (SELECT s.line_id, s.received_at AS utc, coalesce(d.device_zone, 'UTC') AS zone FROM samples s LEFT JOIN sources d USING (source)),
      l AS (SELECT line_id, utc, timezone(zone, timezone('UTC', utc)) AS wall FROM z),
      o AS (SELECT line_id, wall, CAST((epoch_us(wall) - epoch_us(utc)) // 60000000 AS BIGINT) AS m FROM l)
      SELECT line_id, strftime(wall, '%Y-%m-%dT%H:%M:%S') || CASE WHEN m = 0 THEN 'Z' ELSE (CASE WHEN m < 0 THEN '-' ELSE '+' END) || lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') END AS received FROM o""",
    "zone_provenance": f"WITH {_ZONES} SELECT import_id, own AS recorded_zone, zone, own IS NOT NULL AS recorded FROM zoned",
    "url_normalise": """WITH u AS (SELECT doc_id, CASE WHEN n_claims > 8 THEN 'https://' || source || '.example:8787' WHEN n_claims > 4 THEN 'http://' || source || '.example:8787'
      WHEN n_claims > 0 THEN NULL ELSE 'http://' || source || '.example:8787' END AS base FROM documents) SELECT doc_id, base, base || '/ingest' AS ingest_url FROM u""",
    "batch_name": "SELECT element_id, 'batch-' || lpad(CAST(element_id AS VARCHAR), 12, '0') || '-' || substr(coalesce(uuid, queue_id), 1, 8) || '.json' AS name FROM batch_elements",
    "http_status": """SELECT element_id, CAST(CASE WHEN pos = 11 THEN 404 WHEN pos IN (7, 9) THEN 401 WHEN pos = 3 THEN 400 WHEN pos IN (4, 5) THEN 413 WHEN pos IN (2, 6, 8) THEN 400 ELSE 200 END AS INTEGER) AS status,
      pos IS NULL OR pos NOT IN (2, 3, 4, 5, 6, 7, 8, 9, 11) AS delivered FROM batch_elements""",
    "status_label": f"""WITH c AS (SELECT sample_type, count(DISTINCT uuid) AS n FROM samples GROUP BY 1)
      SELECT r.key, r.display, r.grp AS "group", CASE WHEN c.n > 0 THEN c.n || ' delivered' WHEN c.n IS NOT NULL THEN {_quoted(NO_DATA)} ELSE {_quoted(WAITING)} END AS status FROM {_TYPES} LEFT JOIN c ON c.sample_type = r.key""",
    "top_recent": "SELECT line_id, sample_type FROM samples ORDER BY received_at DESC, line_id DESC LIMIT 200",
    "log_tail": "SELECT import_id FROM (SELECT import_id, metadata FROM import_records ORDER BY import_id DESC LIMIT 100) WHERE metadata IS NOT NULL AND json_valid(metadata)",
    "truncate": """WITH b AS (SELECT doc_id, text, pub_number, list_sum(list_transform(range(1, 301), lambda i: CASE WHEN octet_length(encode(substr(text, 1, i))) <= 300 AND i <= length(text) THEN 1 ELSE 0 END)) AS k FROM documents)
      SELECT doc_id, substr(text, 1, CAST(k AS BIGINT)) AS b300, substr(text, 1, 120) AS c120, substr(text, 1, 80) AS c80, substr(text, 1, 160) AS c160, substr(pub_number, 1, 8) AS c8 FROM b""",
    "activity_label": f"SELECT workout_activity_type, count(*) AS n, count(a.name) AS n_known FROM samples LEFT JOIN {_NAMES} ON a.name = workout_activity_type WHERE sample_type = 'workout' GROUP BY 1",
    "json_booleans": "SELECT import_id, j.key AS key, CAST(j.atom ->> '$' AS BOOLEAN) AS value FROM import_records, json_each(metadata) j WHERE j.type = 'BOOLEAN'",
    "workout_projection": f"""WITH w AS (SELECT line_id, source, {_START} AS lo, {_END} AS hi, workout_activity_type, duration, total_energy_burned FROM samples WHERE sample_type = 'workout'),
      h AS (SELECT source, {_START} AS sec, value_num AS v FROM samples WHERE sample_type = 'heartRate' AND value_num IS NOT NULL),
      b AS (SELECT line_id, avg(v) AS a, min(v) AS lo, max(v) AS hi FROM w JOIN h ON w.source = h.source AND sec BETWEEN w.lo AND w.hi GROUP BY 1)
      SELECT w.line_id, workout_activity_type AS activity, duration, round(b.a, 6) AS average_heart_rate, round(b.lo, 6) AS minimum_heart_rate, round(b.hi, 6) AS maximum_heart_rate,
        round(total_energy_burned, 6) AS total_energy, CAST(NULL AS DOUBLE) AS basal_energy, CAST(NULL AS DOUBLE) AS total_distance FROM w LEFT JOIN b USING (line_id)""",
    "batch_codec": "SELECT element_id, uuid, sample_type AS type_key, queue_id, true AS whole FROM batch_elements WHERE uuid IS NOT NULL",
    "p7_steps": f"""WITH {_HOURS},
      g AS (SELECT source, sample_type, h, nh, n, m, unnest(generate_series(h, CASE WHEN nh - h <= 48 THEN nh - 1 ELSE h END)) AS k FROM ahead)
      SELECT source, sample_type, k * 3600 AS step_start, CASE WHEN k = h THEN n ELSE 0 END AS n, round(CASE WHEN k = h THEN m END, 6) AS mean, round(CASE WHEN k - h <= 3 THEN m END, 6) AS filled,
        CASE WHEN k = h THEN 'read' WHEN k - h <= 3 THEN 'carried' ELSE 'missing' END AS state FROM g""",
    "p6_limits": """WITH r AS (SELECT DISTINCT s.uuid, s.source, s.sample_type, s.value_num AS v FROM samples s JOIN sample_types t USING (sample_type) WHERE t.shape IN ('sampled', 'daily') AND s.value_num IS NOT NULL)
      SELECT sample_type, count(*) AS n, count(*) FILTER (CASE sample_type WHEN 'heartRate' THEN v NOT BETWEEN 10 AND 300 WHEN 'respiratoryRate' THEN v NOT BETWEEN 0.5 AND 100 WHEN 'oxygenSaturation' THEN v NOT BETWEEN 40 AND 100
        WHEN 'heartRateVariabilitySDNN' THEN v NOT BETWEEN 0.1 AND 600 WHEN 'environmentalAudioExposure' THEN v NOT BETWEEN 0 AND 194 WHEN 'bodyMass' THEN v NOT BETWEEN 1 AND 650 END) AS n_beyond_limit FROM r GROUP BY 1""",
    "p6_stuck": f"""WITH r AS (SELECT DISTINCT s.uuid, s.source, s.sample_type, {_START} AS t, s.value_num AS v FROM samples s JOIN sample_types k USING (sample_type) WHERE k.shape IN ('sampled', 'daily') AND s.value_num IS NOT NULL),
      e AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY source, sample_type ORDER BY t, uuid) THEN 0 ELSE 1 END AS b FROM r),
      g AS (SELECT *, sum(b) OVER (PARTITION BY source, sample_type ORDER BY t, uuid ROWS UNBOUNDED PRECEDING) AS run FROM e),
      c AS (SELECT uuid, count(*) OVER (PARTITION BY source, sample_type, run) AS n FROM g)
      SELECT uuid FROM c WHERE n >= 10""",
}
