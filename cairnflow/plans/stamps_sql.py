"""SQL that reads stamps, a reader of its own: patterns and DuckDB's zones instead of masks and zone tables."""

from __future__ import annotations

from ..functions.masks import MONTH_FIRST, YEAR_FIRST
from ..functions.zones import ABBREVIATIONS

_OFFSETS = "(VALUES " + ", ".join(f"('{a}', {round(h * 3600)})" for a, h in ABBREVIATIONS.items()) + ") ab(name, off)"
_MONTH_FIRST = ", ".join(f"'{x}'" for x in sorted(MONTH_FIRST))
_YEAR_FIRST = ", ".join(f"'{x}'" for x in sorted(YEAR_FIRST))

FOUND = f"""WITH names AS (SELECT DISTINCT name FROM pg_timezone_names()),
s AS (SELECT import_id, 1 AS side, start_time AS t, metadata, device_zone, file_locale FROM import_records UNION ALL SELECT import_id, 2, end_time, metadata, device_zone, file_locale FROM import_records),
a AS (SELECT import_id, side, trim(t) AS t, coalesce(m.name, d.name) AS wide, file_locale AS loc FROM s LEFT JOIN names m ON m.name = (metadata ->> '$.timeZone') LEFT JOIN names d ON d.name = device_zone),
b AS (SELECT *, regexp_extract(t, '^([0-9]{{9,19}})(\\.[0-9]+)?$', 1) AS whole, regexp_extract(t, '^[0-9]{{9,19}}(\\.[0-9]+)?$', 1) AS frac,
  regexp_replace(t, '\\[[^\\]]*\\]$', '') AS u, regexp_extract(t, '\\[([^\\]]*)\\]$', 1) AS named FROM a),
c AS (SELECT *, regexp_extract(u, '(?:[0-9]:[0-9]{{2}}(?:\\.[0-9]+)?|T[0-9]{{6}}) ?([+-][0-9]{{2}}:?(?:[0-9]{{2}})?)$', 1) AS off, upper(regexp_extract(u, ' ?([A-Za-z]+)$', 1)) AS word FROM b),
d AS (SELECT *, regexp_replace(regexp_replace(u, ' ?[+-][0-9]{{2}}:?(?:[0-9]{{2}})?$', CASE WHEN off = '' THEN '\\0' ELSE '' END), ' ?[A-Za-z]+$', '') AS v FROM c),
e AS (SELECT *,
  CASE WHEN regexp_full_match(v, '[0-9]{{4}}([-/])[0-9]{{2}}[-/][0-9]{{2}}[ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]{{1,9}})?)?') THEN [v[1:4], v[6:7], v[9:10]]
    WHEN regexp_full_match(v, '[0-9]{{8}}T[0-9]{{6}}') THEN [v[1:4], v[5:6], v[7:8]]
    WHEN regexp_full_match(v, '[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}} [0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?') THEN
      CASE WHEN loc IN ({_MONTH_FIRST}) THEN [regexp_extract(v, '^[0-9]+.[0-9]+.([0-9]{{4}})', 1), regexp_extract(v, '^([0-9]+)', 1), regexp_extract(v, '^[0-9]+.([0-9]+)', 1)]
        WHEN loc IS NULL OR substr(loc, 1, 2) IN ({_YEAR_FIRST}) OR loc = 'en' THEN NULL
        ELSE [regexp_extract(v, '^[0-9]+.[0-9]+.([0-9]{{4}})', 1), regexp_extract(v, '^[0-9]+.([0-9]+)', 1), regexp_extract(v, '^([0-9]+)', 1)] END
    WHEN regexp_full_match(v, '([A-Z][a-z]{{2}}, )?[0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}} [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}') THEN
      [regexp_extract(v, ' ([0-9]{{4}}) ', 1), regexp_extract(v, '[0-9] ([A-Z][a-z]{{2}}) ', 1), regexp_extract(v, '([0-9]{{1,2}}) [A-Z]', 1)]
    WHEN regexp_full_match(v, '[A-Z][a-z]{{2}} [0-9]{{1,2}}, [0-9]{{4}} at [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}') THEN [regexp_extract(v, ', ([0-9]{{4}})', 1), v[1:3], regexp_extract(v, '^[A-Z][a-z]{{2}} ([0-9]+)', 1)]
  END AS ymd,
  CASE WHEN regexp_full_match(v, '[0-9]{{8}}T[0-9]{{6}}') THEN v[10:11] || ':' || v[12:13] || ':' || v[14:15] ELSE regexp_extract(v, '[ T]([0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)(\\.[0-9]+)?$', 1) END AS hms,
  rpad(substr(regexp_extract(v, ':[0-9]{{2}}\\.([0-9]+)$', 1), 1, 6), 6, '0') AS us FROM d),
f AS (SELECT *, TRY_CAST(ymd[1] AS INTEGER) AS y, coalesce(TRY_CAST(ymd[2] AS INTEGER), 1 + list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], ymd[2]) - 1) AS m, TRY_CAST(ymd[3] AS INTEGER) AS dd,
  TRY_CAST(string_split(hms, ':')[1] AS INTEGER) AS h0, TRY_CAST(string_split(hms, ':')[2] AS INTEGER) AS mi, coalesce(TRY_CAST(string_split(hms, ':')[3] AS INTEGER), 0) AS se FROM e),
g AS (SELECT *, word IN ('AM', 'PM') AS half, CASE WHEN word IN ('AM', 'PM') THEN CASE WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE word WHEN 'PM' THEN 12 ELSE 0 END END WHEN h0 < 24 THEN h0 END AS h FROM f),
k AS (SELECT g.*, ab.off AS abo, TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, dd, h, mi, se) AS TIMESTAMP) AS wall FROM g LEFT JOIN {_OFFSETS} ON ab.name = word AND NOT half AND word <> ''),
z AS (SELECT *, CASE WHEN named <> '' THEN (SELECT max(name) FROM names WHERE name = named) ELSE wide END AS zone,
  CASE WHEN off <> '' THEN (CASE off[1] WHEN '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS INTEGER) * 3600 + coalesce(TRY_CAST(right(off, length(off) - 3) AS INTEGER), TRY_CAST(right(off, 2) AS INTEGER) * CASE WHEN length(off) > 3 THEN 1 ELSE 0 END, 0) * 60)
    WHEN abo IS NOT NULL THEN abo END AS own,
  word <> '' AND NOT half AND abo IS NULL AS odd FROM k),
cand AS (SELECT import_id, side, wall, zone, list_distinct([epoch_us(timezone(zone, wall)) + x * 1800000000 for x in range(-4, 5)]) AS us FROM z WHERE own IS NULL AND NOT odd AND wall IS NOT NULL AND zone IS NOT NULL),
fit AS (SELECT import_id, side, min(x) AS x, count(*) AS n FROM (SELECT import_id, side, wall, zone, unnest(us) AS x FROM cand) WHERE timezone(zone, make_timestamptz(x)) = wall GROUP BY ALL),
r AS (SELECT z.import_id, z.side, CASE
  WHEN whole <> '' THEN (SELECT max(v) FROM (SELECT unnest([
      CASE WHEN TRY_CAST(whole AS HUGEINT) BETWEEN 1577836800 AND 1798761599 THEN TRY_CAST(whole AS HUGEINT) * 1000000 + CAST(rpad(substr(coalesce(frac[2:], ''), 1, 6), 6, '0') AS BIGINT) END,
      CASE WHEN TRY_CAST(whole AS HUGEINT) + 978307200 BETWEEN 1577836800 AND 1798761599 THEN (TRY_CAST(whole AS HUGEINT) + 978307200) * 1000000 + CAST(rpad(substr(coalesce(frac[2:], ''), 1, 6), 6, '0') AS BIGINT) END,
      CASE WHEN TRY_CAST(whole AS HUGEINT) // 1000 BETWEEN 1577836800 AND 1798761599 THEN TRY_CAST(whole AS HUGEINT) * 1000 END,
      CASE WHEN TRY_CAST(whole AS HUGEINT) // 1000000 BETWEEN 1577836800 AND 1798761599 THEN TRY_CAST(whole AS HUGEINT) END,
      CASE WHEN TRY_CAST(whole AS HUGEINT) // 1000000000 BETWEEN 1577836800 AND 1798761599 THEN TRY_CAST(whole AS HUGEINT) // 1000 END]) AS v))
  WHEN wall IS NULL OR odd THEN NULL
  WHEN own IS NOT NULL THEN epoch_us(wall) - CAST(own AS BIGINT) * 1000000 + CAST(us AS BIGINT)
  WHEN fit.n = 1 THEN fit.x + CAST(us AS BIGINT) END AS us FROM z LEFT JOIN fit ON fit.import_id = z.import_id AND fit.side = z.side)
SELECT a.import_id, CAST(a.us AS BIGINT) AS start_us, CAST(b.us AS BIGINT) AS end_us FROM r a JOIN r b ON a.import_id = b.import_id WHERE a.side = 1 AND b.side = 2 AND a.us IS NOT NULL AND b.us IS NOT NULL"""
