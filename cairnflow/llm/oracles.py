"""SQL with the results of the queries on texts, written independently of them, over the same whole tables."""

from __future__ import annotations

_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ß": "ss"}


def _folded(text: str) -> str:
    out = f"regexp_replace({text}, '\u00AD[ \\t]*(\\r?\\n[ \\t]*)?|[\u200B-\u200D\u2060\uFEFF]', '', 'g')"
    for a, b in _LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"lower({out})"


_WORDS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"
#: A word divided at a line end is read as one and as two.
_GRAMS = f"""d AS (SELECT doc_id, {_folded('text')} AS t FROM documents),
r AS (SELECT doc_id, t FROM d UNION SELECT doc_id, regexp_replace(t, '[-‐‑¬][ \\t]*\\r?\\n[ \\t]*', '', 'g') FROM d),
w AS (SELECT doc_id, {_WORDS.format('t')} AS ws FROM r),
g AS (SELECT doc_id, array_to_string(ws[i : i + 11], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w)),
iw AS (SELECT item_id, {_WORDS.format(_folded('item_text'))} AS ws FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + 11], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM iw)),
hits AS (SELECT DISTINCT doc_id, item_id FROM g JOIN ig USING (gram))"""

_LETTERS = "regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+')"

SQL = {
    "p8_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM hits",
    "p8_items": f"""WITH {_GRAMS}, n AS (SELECT item_id, count(*) AS n FROM hits GROUP BY 1)
      SELECT item_id, len(ws) AS n_words, len(ws) >= 12 AS searchable, coalesce(n.n, 0) AS n_docs FROM iw LEFT JOIN n USING (item_id)""",
    "p9_kept": """WITH t AS (SELECT d.doc_id, d.source, md5(d.text) AS k, d.text FROM documents d JOIN mix_targets USING (source) WHERE d.text <> ''),
      u AS (SELECT k, arg_min(source, doc_id) AS source FROM t GROUP BY 1)
      SELECT source, count(u.k) AS n_texts, true AS share_kept, true AS repeats_kept FROM mix_targets LEFT JOIN u USING (source) GROUP BY 1""",
    "p10_counts": f"""WITH w AS (SELECT doc_id, text, {_LETTERS} AS ws, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
      f AS (SELECT doc_id, lang, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM w) JOIN (SELECT DISTINCT lang, lower(word) AS word FROM common_words) USING (word) GROUP BY ALL),
      m AS (SELECT doc_id, max(n) AS n FROM f GROUP BY 1)
      SELECT doc_id, length(text) AS n_chars, len(ws) AS n_words, round(CASE WHEN len(ls) = 0 THEN 0 ELSE (len(ls) - len(list_distinct(ls))) / len(ls) END, 9) AS duplicate_lines,
        round(CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(m.n, 0) / len(ws) END, 9) AS common_words FROM w LEFT JOIN m USING (doc_id)""",
}
