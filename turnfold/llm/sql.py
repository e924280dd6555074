"""DuckDB SQL for the queries that SQL can express."""

from .mixing import PART, POWER, TAIL
from .queries import MIX_SEED

OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

OP10 = f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0) AS size FROM documents GROUP BY source),
whole AS (SELECT sum(size) AS all_size, sum(pow(size::DOUBLE, {POWER})) AS all_weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE pow(size::DOUBLE, {POWER}) * all_size / (all_weight * size) END AS rate FROM sizes, whole),
parts AS (
  SELECT d.*, r.rate, greatest(1, ceil(r.rate / {PART})::INT) AS parts,
    coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, '')) AS k
  FROM documents d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source),
draws AS (
  SELECT doc_id, k, rate / parts AS mean, j,
    ('0x' || substr(md5('{MIX_SEED}:' || k || ':' || j), 1, 13))::BIGINT::DOUBLE / {1 << 52}.0 AS u
  FROM (SELECT doc_id, k, rate, parts, unnest(range(1, parts + 1)) AS j FROM parts)),
cdf AS (
  SELECT mean, t, sum(p) OVER (PARTITION BY mean ORDER BY t) AS c
  FROM (SELECT mean, t, exp(-mean + t * ln(mean) - lgamma(t + 1)) AS p
    FROM (SELECT DISTINCT mean FROM draws WHERE mean > 0), (SELECT unnest(range(0, {TAIL})) AS t))),
counts AS (SELECT d.k, d.j, count(*) AS n FROM draws d JOIN cdf ON cdf.mean = d.mean AND d.u >= cdf.c GROUP BY d.k, d.j),
copies AS (SELECT k, sum(n)::BIGINT AS n FROM counts GROUP BY k)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n)) AS copy
FROM parts JOIN copies USING (k)
"""

ORACLE_SQL = {"op9_near_dedup": OP9, "op10_mixing": OP10}
