"""DuckDB SQL for the queries that SQL expresses, written independently of the Spark plans."""

op2_minhash_near_dedup = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) = 1 THEN [l[1]]
         ELSE list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) END AS g FROM w),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY ALL),
e AS MATERIALIZED (SELECT id, n, unnest(g) AS g FROM c),
df AS (SELECT g, count(*) AS f FROM e GROUP BY g),
o AS (SELECT id, n, e.g, row_number() OVER (PARTITION BY id ORDER BY f, e.g) AS r FROM e JOIN df USING (g)),
p AS MATERIALIZED (SELECT id, n, g FROM o WHERE r <= n - ceil(0.8 * n) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.id < b.id AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n),
inter AS (SELECT a, b, na, nb, count(*) AS i FROM cand JOIN e x ON x.id = a JOIN e y ON y.id = b AND x.g = y.g GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM inter WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT id, id FROM c UNION SELECT reach.id, b FROM reach JOIN both_ways ON a = r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN comp ON comp.id = c.id
"""

op5_url_filters = r"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
outcome AS (
  SELECT host, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS k
  FROM split JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY host),
h AS (
  SELECT e.host, regexp_extract(e.host, '([^.]*\.)?[^.]*$', 0) AS domain, regexp_extract(e.host, '[^.]*$', 0) AS suffix,
         CAST(coalesce(n, 0) AS DOUBLE) AS n, CAST(coalesce(k, 0) AS DOUBLE) AS k
  FROM (SELECT DISTINCT host FROM split) e LEFT JOIN outcome USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
base AS (SELECT coalesce((sum(k) + 1) / (sum(n) + 2), 0.5) AS p FROM s),
units AS (SELECT 'h' AS level, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s),
moments AS (
  SELECT level, count(*) AS m, sum(n) AS total, sum(n * n) AS squares, sum(n * (k / n - p) * (k / n - p)) AS spread, any_value(p * (1 - p)) AS v
  FROM units, base WHERE n > 0 GROUP BY level),
strength AS (
  SELECT level, CASE WHEN tau <= v / 1001.0 THEN 1000.0 ELSE greatest(v / tau - 1, 1.0) END AS w
  FROM (SELECT level, v, CASE WHEN m > 1 AND total - squares / total > 0
        THEN (spread - (m - 1) * v) / (total - squares / total) ELSE 0.0 END AS tau FROM moments)),
w AS (SELECT coalesce(max(w) FILTER (level = 'h'), 1000.0)::DOUBLE AS wh, coalesce(max(w) FILTER (level = 'd'), 1000.0)::DOUBLE AS wd,
             coalesce(max(w) FILTER (level = 's'), 1000.0)::DOUBLE AS ws FROM strength),
sp AS (SELECT suffix, (k + ws * p) / (n + ws) AS mean FROM s, w, base),
dp AS (SELECT domain, (k + wd * mean) / (n + wd) AS mean FROM d JOIN sp USING (suffix), w),
hp AS (SELECT host, n + wh AS size, (k + wh * mean) / (n + wh) AS mean FROM h JOIN dp USING (domain), w),
bound AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS b FROM hp),
rules(action, rule, name, rest) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fit AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
  FROM split LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, rest)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN b > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(b, 6) AS bad_bound
FROM fit JOIN bound USING (host)
"""

op10_chat_formatting = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS l, count(*) AS n_turns FROM n GROUP BY conv_id),
u AS (SELECT l, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l, n_turns),
kept AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n_turns > a.n_turns AND b.l[1] = a.l[1] AND b.l[1:a.n_turns] = a.l))
SELECT k.conv_id, CAST((pos - 1) // 256 AS BIGINT) AS part, k.n_turns, k.copies,
       string_agg('<|im_start|>' || replace(role, '<|', '<||') || chr(10) || replace(text, '<|', '<||') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM kept k JOIN n ON n.conv_id = k.conv_id GROUP BY k.conv_id, (pos - 1) // 256, k.n_turns, k.copies
"""
