"""DuckDB SQL that gives what the queries of the same names give."""

from __future__ import annotations

from millrace.llm import quality
from millrace.llm.url_filter import HOST


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _written(words: list[str]) -> list[str]:
    return [x for w in words for x in dict.fromkeys((w, w.capitalize(), w.upper()))]


def _distance(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    p, q = f"({counts}[i] / list_sum({counts})::DOUBLE)", f"({reference}[i] / list_sum({reference})::DOUBLE)"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {part(p)} + {part(q)})) / 2))"


_CASE = lambda make: "CASE l " + " ".join(f"WHEN '{k}' THEN {_list(make(w))}" for k, w in quality.COMMON.items()) + " END"
_LONGEST = 1 + max(map(len, quality.COMMON.values()))

#: Histograms, references and distances as the operator has them; repeated windows by position.
OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in quality.COMMON)}) THEN lang ELSE 'other' END AS l FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(t, '{quality.PLAIN}', '', 'g') AS mk, {_CASE(list)} AS lst, {_CASE(_written)} AS written FROM d),
k AS (SELECT *, len(ws) AS n, length(array_to_string(ws, '')) AS wc, length(t) AS chars, length(mk) AS marks, len(regexp_extract_all(mk, '\p{{Lu}}')) AS up, len(regexp_extract_all(mk, '\p{{Nd}}')) AS dg,
    len(regexp_extract_all(mk, '[.,;:''\"()?-]')) AS pu, list_transform(list_filter(ws, lambda x: list_contains(written, x)), lambda x: lower(x)) AS known,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
f AS (SELECT *, [wc - marks, chars - wc, up, dg, pu, marks - up - dg - pu] AS classes,
    CASE WHEN lst IS NOT NULL THEN list_concat(list_transform(lst, lambda y: len(list_filter(known, lambda x: x = y))), [n - len(known)]) ELSE [n] END AS common FROM k),
refs AS (SELECT l, [{", ".join(f"sum(classes[{i}])" for i in range(1, 7))}] AS rc, list_filter([{", ".join(f"sum(common[{i}])" for i in range(1, _LONGEST + 1))}], lambda x: x IS NOT NULL) AS rw FROM f WHERE n >= {quality.MIN_WORDS} AND classes[1] >= {quality.MIN_LETTERS}::DOUBLE * wc GROUP BY l),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS c FROM (SELECT rid, ws, unnest(range(1, n - 1)) AS i FROM f WHERE n >= 3)),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_repeat FROM win, range(0, 3) x(o) WHERE c > 1 GROUP BY rid),
j AS (SELECT f.*, coalesce(n_repeat, 0) AS n_repeat, {_distance("classes", "rc")} AS cd, {_distance("common", "rw")} AS wd FROM f LEFT JOIN refs USING (l) LEFT JOIN rep USING (rid))
SELECT doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, len(regexp_extract_all(mk, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
  n < 50 OR 100 * n_repeat > 50 * n AS base_failed,
  NOT (n < 50 OR 100 * n_repeat > 50 * n) AND NOT (n >= {quality.MIN_WORDS} AND chars >= {quality.MIN_CHARS} AND (coalesce(cd > greatest({quality.CLASS_FLOOR}, {quality.CLASS_SPREAD} / sqrt(n)), false) OR coalesce(wd > greatest({quality.WORD_FLOOR}, {quality.WORD_SPREAD} / sqrt(n)), false))) AS kept
FROM j
"""

_NODES = "sha256(string_agg(place || ':' || {0}, ',' ORDER BY place) FILTER ({0} IS NOT NULL)) AS {0}"
_ABOVE = "SELECT file_id, place // 16 AS place, " + _NODES.format("h") + ", " + _NODES.format("g") + " FROM {} GROUP BY 1, 2"

#: Damage located by comparing all records; roots by joining digests level by level.
OP7 = f"""
WITH r AS (
  SELECT page_id, url, html, page_id % 307 = 50 AS lost,
    CASE WHEN page_id % 97 = 13 THEN '#' || substr(html, 2) WHEN page_id % 211 = 5 THEN substr(html, 1, length(html) - 1) ELSE html END AS bad
  FROM pages),
b AS (
  SELECT page_id, page_id // 512 AS file_id, lost,
    'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || url || '\r\nContent-Type: text/html\r\nContent-Length: ' AS head, html, bad FROM r),
w AS (SELECT page_id, file_id, head || strlen(html) || '\r\n\r\n' || html || '\r\n\r\n' AS rec, CASE WHEN NOT lost THEN head || strlen(bad) || '\r\n\r\n' || bad || '\r\n\r\n' END AS rep FROM b),
l AS (SELECT page_id, file_id, page_id % 512 AS place, row_number() OVER (PARTITION BY file_id ORDER BY page_id) - 1 AS seq,
    coalesce(sum(strlen(rec)) OVER (PARTITION BY file_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset,
    strlen(rec)::BIGINT AS n_bytes, sha256(rec) AS h, sha256(rep) AS g FROM w),
l0 AS (SELECT file_id, place, sha256(page_id || ':' || h) AS h, sha256(page_id || ':' || g) AS g FROM l),
l1 AS ({_ABOVE.format("l0")}), l2 AS ({_ABOVE.format("l1")}), l3 AS ({_ABOVE.format("l2")})
SELECT page_id, l.file_id, l.seq::BIGINT AS seq, start_offset, n_bytes, l.h AS leaf_hash, l.g AS replica_hash, l3.h AS root_hash, l3.g AS replica_root_hash, CASE WHEN l.g IS NULL THEN 'missing' ELSE 'changed' END AS kind
FROM l JOIN l3 ON l.file_id = l3.file_id WHERE l.h IS DISTINCT FROM l.g
""".replace("\r\n", "' || chr(13) || chr(10) || '")

OP9 = f"""
WITH cap AS (
  SELECT row_number() OVER () AS rid, page_id, nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.+$', ''), '') AS host,
    1704067200 + page_id % 8760 * 3600 AS ts FROM pages),
hosts AS (SELECT DISTINCT host, substr(md5(host), 1, 1) AS d FROM cap WHERE host IS NOT NULL),
entries AS (
  SELECT 'spam' AS list, 'block' AS action, host AS key, epoch(TIMESTAMP '2024-02-01')::BIGINT AS ts, true AS added FROM hosts WHERE d IN ('0','1','2','3')
  UNION ALL SELECT 'spam', 'block', host, epoch(TIMESTAMP '2024-05-01')::BIGINT, false FROM hosts WHERE d IN ('0','1','2','3')
  UNION ALL SELECT 'spam', 'block', host, epoch(TIMESTAMP '2024-09-15')::BIGINT, true FROM hosts WHERE d IN ('0','1','2','3')
  UNION ALL SELECT 'malware', 'block', host, epoch(TIMESTAMP '2024-03-10')::BIGINT, true FROM hosts WHERE d IN ('4','5','6')
  UNION ALL SELECT 'trusted', 'allow', host, epoch(TIMESTAMP '2024-01-15')::BIGINT, true FROM hosts WHERE d IN ('e','f')
  UNION ALL SELECT 'trusted', 'allow', host, epoch(TIMESTAMP '2024-11-01')::BIGINT, false FROM hosts WHERE d IN ('e','f')
  UNION ALL SELECT 'parents', 'block', 'example.org', epoch(TIMESTAMP '2024-06-01')::BIGINT, true
  UNION ALL SELECT 'parents', 'block', 'example.org', epoch(TIMESTAMP '2024-07-01')::BIGINT, false
  UNION ALL SELECT 'spam', 'block', 'cheap-pills.example.com', epoch(TIMESTAMP '2024-01-20')::BIGINT, true),
once AS (SELECT list, key, ts, bool_and(added) AS added, min(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT list, action, key, ts AS since, added, lead(ts) OVER (PARTITION BY list, key ORDER BY ts) AS until FROM once),
parts AS (SELECT rid, ts, string_split(host, '.') AS p FROM cap WHERE host IS NOT NULL),
keyed AS (SELECT rid, ts, unnest(list_transform(range(1, greatest(len(p) - 1, 1) + 1), lambda i: array_to_string(p[i:], '.'))) AS key FROM parts),
hits AS (
  SELECT k.rid, k.key, s.list, s.action, s.since, count(*) OVER (PARTITION BY rid) AS n,
    row_number() OVER (PARTITION BY rid ORDER BY length(k.key) DESC, s.since DESC, s.list DESC) AS rank
  FROM keyed k JOIN spans s ON k.key = s.key AND s.added AND k.ts >= s.since AND (s.until IS NULL OR k.ts < s.until))
SELECT page_id, host, ts AS fetched_s, coalesce(n, 0) AS n_active, coalesce(action = 'block', false) AS blocked, key AS matched_key, list AS matched_list, since AS since_s
FROM cap LEFT JOIN hits ON cap.rid = hits.rid AND rank = 1
"""

#: Main text of the test pages by what their tags say: the article, cut at paragraphs and headings. (The operator doesn't read
#: it so: it finds the region by the wrapper.) Named references are those that the pages have.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "#39": "\'\'", "#x27": "\'\'", "copy": "©", "middot": "·", "nbsp": " ", "amp": "&"}
_UNESCAPED = "regexp_replace(x, '<[^>]*>', '', 'g')"
for _name, _char in _NAMED.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', '{_char}')"
    if _name.isalpha():  # one that a page's end cuts off
        _UNESCAPED = f"regexp_replace({_UNESCAPED}, '&{_name}$', '{_char}')"
OP5 = rf"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1), '<(/?[a-z!][^>]*)?\z', '') AS body FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda x: trim(regexp_replace({_UNESCAPED}, '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM b
"""

ORACLES = {"op2_quality": OP2, "op5_html_text": OP5, "op7_warc_fixity": OP7, "op9_url_filter": OP9}
