"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op6_url_rules": r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
places AS (SELECT DISTINCT host, path FROM parts),
fits AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM places p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY 1, 2)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT * FROM r WHERE rank <= 5
""",
    "op3_near_duplicates": r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) = 1 THEN ws
           ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT s, count(*) AS df FROM g GROUP BY s),
o AS (
  SELECT g.doc_id, g.s, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY df, g.s) AS r
  FROM g JOIN f USING (s) JOIN n USING (doc_id)),
p AS (SELECT * FROM o WHERE r <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id),
l AS (
  SELECT c.a, c.b FROM c JOIN g x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b AND y.s = x.s
  JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b
  GROUP BY c.a, c.b, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id,
       coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
""",
    "op9_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
s AS (SELECT doc_id, t, length(t) // 2 AS n FROM h),
w AS (SELECT doc_id, i, substr(t, CAST(2 * i + 1 AS BIGINT), 100) AS x FROM s, unnest(range(greatest(n - 49, 0))) AS u(i)),
m AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x),
c AS (SELECT w.doc_id, w.i FROM w JOIN m USING (x) WHERE m.least < w.doc_id),
b AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, k),
q AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY k) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM r),
v AS (
  SELECT q.doc_id, sum(z - a) AS removed, count(*) AS spans,
         max(CASE WHEN j = 1 THEN substr(t, 1, CAST(2 * a AS BIGINT)) END)
         || string_agg(substr(t, CAST(2 * z + 1 AS BIGINT), CAST(2 * (coalesce(nxt, n) - z) AS BIGINT)), '' ORDER BY j) AS kept
  FROM q JOIN s USING (doc_id) GROUP BY q.doc_id)
SELECT s.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, t))) AS kept_sha256
FROM s LEFT JOIN v USING (doc_id)
""",
}
