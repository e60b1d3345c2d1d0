"""DuckDB twins of the queries that SQL can express, each written from the definition."""

ORACLE_SQL = {
    # All pairs that share a shingle, then the classes by recursion: fine for small tables.
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT c.a, c.b, c.both = x.n AND c.both = y.n AS same FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
  WHERE 5 * c.both >= 4 * (x.n + y.n - c.both)
  UNION ALL
  SELECT x.doc_id, y.doc_id, true FROM n x JOIN n y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY 1),
l AS (SELECT a, count(*) AS links, count(*) FILTER (same) AS twins, min(b) FILTER (same) AS twin FROM e GROUP BY 1)
SELECT n.doc_id, k.class_id, least(n.doc_id, coalesce(l.twin, n.doc_id)) AS text_id,
  1 + coalesce(l.twins, 0) AS copies, coalesce(l.links, 0) AS n_links
FROM n JOIN k ON k.a = n.doc_id LEFT JOIN l ON l.a = n.doc_id
""",
    "op2_url_filter": r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, rhost, rpath, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(v, length(rule)) FROM r
            WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM p
""",
    # Every 50-byte string with the smallest document it starts in, as hexadecimal text.
    "op3_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g
      FROM (SELECT doc_id, h, unnest(range(0, greatest(n_bytes - 49, 0))) AS p FROM n)),
m AS (SELECT g, min(doc_id) AS first_id FROM w GROUP BY g),
c AS (SELECT w.doc_id, w.p FROM w JOIN m USING (g) WHERE m.first_id < w.doc_id),
f AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS fresh FROM c),
q AS (SELECT doc_id, p, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM q GROUP BY 1, 2),
g AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s),
t AS (SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
        string_agg(substr(n.h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept
      FROM g JOIN n USING (doc_id) GROUP BY 1)
SELECT n.doc_id, n.n_bytes::BIGINT AS n_bytes, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
  coalesce(t.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN n.h ELSE t.kept || substr(n.h, 2 * t.last + 1) END)) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)
""",
    "op4_secret_scan": r"""
WITH k(rank, kind, rx, grp, least_n) AS (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', '(AKIA[A-Z0-9]+)', 1, 20),
  (2, 'hex', '([0-9a-f]+)', 1, 24)),
m AS (
  SELECT doc_id, rank, kind, least_n, CASE rank
      WHEN 0 THEN regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
      WHEN 1 THEN regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+', 0)
      ELSE regexp_extract_all(coalesce(text, ''), '[0-9a-f]+', 0) END AS found,
    CASE rank
      WHEN 0 THEN regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
      WHEN 1 THEN regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+', 0)
      ELSE regexp_extract_all(coalesce(text, ''), '[0-9a-f]+', 0) END AS judged,
    CASE rank
      WHEN 0 THEN string_split_regex(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN string_split_regex(coalesce(text, ''), 'AKIA[A-Z0-9]+')
      ELSE string_split_regex(coalesce(text, ''), '[0-9a-f]+') END AS gaps
  FROM documents, k),
x AS (SELECT doc_id, rank, kind, least_n, unnest(range(1, len(found) + 1)) AS i, found, judged, gaps FROM m),
y AS (SELECT doc_id, rank, kind, least_n, i, length(found[i]) AS n, length(judged[i]) AS j, length(gaps[i]) AS g FROM x),
z AS (SELECT *, sum(n + g) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM y),
s AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h,
        string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, rank) AS spans
      FROM z WHERE j >= least_n GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN s USING (doc_id)
""",
    "op10_threshold_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_filter_audit": r"""
WITH m AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (min(doc_id) OVER (PARTITION BY t) < doc_id)::INT AS mask
  FROM d LEFT JOIN m USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY 1, 2),
l(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM l p JOIN l q ON q.x <> p.x JOIN l r ON r.x NOT IN (p.x, q.x) JOIN l s ON s.x NOT IN (p.x, q.x, r.x)
    JOIN l t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
k AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
a AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & gone <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM c, k GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM a
""",
}
