"""What the removal and link operators return, as SQL for DuckDB."""

WORDS = "[^\\x20\\x09-\\x0D]+"

SUBSTRING_WORDS = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM split),
windows AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS w FROM starts),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM windows),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM split),
flagged AS (SELECT w.doc_id, w.word, w.p, CASE WHEN c.n > 1 THEN 1 ELSE 0 END AS hit FROM words w LEFT JOIN counted c ON c.doc_id = w.doc_id AND c.i = w.p),
judged AS (SELECT doc_id, word, p, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM flagged)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(count(*) FILTER (j.gone = 1) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.p) FILTER (j.gone = 0), '')) AS kept_sha256
FROM split s LEFT JOIN judged j ON j.doc_id = s.doc_id GROUP BY s.doc_id, len(s.ws)
"""

SUBSTRING_BYTES = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM raw),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b, CASE WHEN 2 * p + 200 <= len(h) THEN substr(h, 2 * p + 1, 200) END AS w FROM bytes),
flagged AS (SELECT doc_id, p, b, CASE WHEN w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS hit FROM windows),
judged AS (SELECT doc_id, p, b, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM flagged),
runs AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM judged)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(count(*) FILTER (r.gone = 1) AS BIGINT) AS n_removed,
  CAST(count(*) FILTER (r.gone = 1 AND r.before = 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(string_agg(r.b, '' ORDER BY r.p) FILTER (r.gone = 0), ''))) AS kept_sha256
FROM raw d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id, len(d.h)
"""

JACCARD = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM split WHERE len(ws) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 90 * (a.n + b.n - s.n)),
near(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT n.id, l.b FROM near n JOIN (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links) l ON l.a = n.other)
SELECT n.id AS doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(n.other) AS component_id FROM near n LEFT JOIN sizes s ON s.doc_id = n.id GROUP BY n.id
"""
