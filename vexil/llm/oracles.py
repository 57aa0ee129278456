"""DuckDB SQL for the queries of this subpackage that SQL can express; each takes a plainer path than the query does."""

#: All deletion variants of all lines, without the search for shared halves.
LINE_DEDUP = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
lines AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM raw),
firsts AS (SELECT t, min((doc_id, line)) AS f FROM lines WHERE t <> '' GROUP BY t),
spots AS (SELECT t, f, unnest(range(1, length(t) + 1)) AS i FROM firsts),
less AS (SELECT f, i, md5(substring(t, 1, i - 1) || substring(t, i + 1)) AS v FROM spots),
whole AS (SELECT f, md5(t) AS v FROM firsts),
same AS (SELECT f, min(f) OVER (PARTITION BY v, i) AS o FROM less),
gone AS (
  SELECT f FROM same WHERE o < f
  UNION SELECT l.f FROM less l JOIN whole w USING (v) WHERE w.f < l.f
  UNION SELECT w.f FROM less l JOIN whole w USING (v) WHERE l.f < w.f),
kept AS (SELECT f FROM firsts WHERE f NOT IN (SELECT f FROM gone)),
marked AS (SELECT l.doc_id, l.line, r.raw, t = '' AS blank, (l.doc_id, l.line) IN (SELECT f FROM kept) AS stays FROM lines l JOIN raw r USING (doc_id, line))
SELECT d.doc_id, count(m.line) FILTER (WHERE NOT blank) AS n_lines, count(m.line) FILTER (WHERE NOT blank AND stays) AS n_kept,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE blank OR stays), '')) END AS text_md5
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text
"""

#: All alignments that share enough words, without masks.
DECONTAMINATE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT doc_id, len(ws) AS nd, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM dw),
i AS (SELECT item_id, len(ws) AS ni, unnest(ws) AS w, unnest(range(0, len(ws))) AS q FROM iw WHERE len(ws) >= 5),
m AS (SELECT doc_id, item_id, p - q AS shift, q, least(13, ni) AS win, ni, least(ni, nd - (p - q)) AS hi, greatest(0, q - p) AS lo FROM d JOIN i USING (w)),
n AS (SELECT *, least(q, hi - win) AS s FROM m WHERE hi - lo >= win QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= 4),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN (q - s) PRECEDING AND (s + win - 1 - q) FOLLOWING) AS k FROM n),
b AS (SELECT doc_id, item_id, shift, win, ni, max(k) AS k FROM c GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(win) AS BIGINT) AS "window", CAST(max(k) AS BIGINT) AS matched, CAST(min(shift) AS BIGINT) AS shift
FROM b WHERE k >= ceil(win * 80 / 100.0) GROUP BY doc_id, item_id
"""


#: Digests in base 32 are spelled from the hexadecimal ones, five digits of which are four letters.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
n AS (SELECT page_id, strlen(body) AS size, h, list_transform(range(0, 8), lambda i: CAST('0x' || substring(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM n JOIN f USING (h)
"""


SQL = {"op2_line_dedup": LINE_DEDUP, "op5_decontaminate": DECONTAMINATE, "op7_warc_revisits": WARC}
