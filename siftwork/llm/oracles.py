"""SQL of llm queries that needs all windows or all pairs; it runs on the small tables only."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
earliest AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.p FROM win JOIN earliest USING (s) WHERE earliest.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit CROSS JOIN (SELECT unnest(range(13)) AS k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '') AS text
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

#: Bytes as hex digits, two for each.
SUFFIX_DEDUP = """
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
win AS (SELECT doc_id, p, md5(b[2 * p + 1:2 * p + 100]) AS s FROM (SELECT doc_id, b, unnest(range(0, len(b) // 2 - 49)) AS p FROM w WHERE len(b) >= 100)),
earliest AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.p FROM win JOIN earliest USING (s) WHERE earliest.d < win.doc_id),
breaks AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM breaks),
gone AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM runs GROUP BY doc_id, r),
parts AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM gone),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last, string_agg(b[2 * from_ + 1:2 * a], '' ORDER BY a) AS front FROM parts JOIN w USING (doc_id) GROUP BY doc_id)
SELECT w.doc_id, len(b) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || b[2 * coalesce(last, 0) + 1:])) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN least_id ON least_id.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
