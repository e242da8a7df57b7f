"""DuckDB SQL of every query that SQL expresses, over the same tables."""

from __future__ import annotations

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOK = "regexp_extract_all(" + _LOW + ", '[a-z0-9]+')"


def _ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


DOCS = f"docs AS (SELECT doc_id, l, len(l) AS dl FROM (SELECT doc_id, {_TOK.format('text')} AS l FROM documents) WHERE len(l) > 0)"
TOKENS = "tok AS (SELECT doc_id, dl, unnest(l) AS term FROM docs)"
POSTS = "posts AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM tok GROUP BY ALL)"
STATS = "stats AS (SELECT count(*) AS n_docs, coalesce(sum(dl), 0)::BIGINT AS sum_dl, sum(dl) / count(*) AS avgdl FROM docs)"
TOPIC = (f"qtok AS (SELECT item_id AS qid, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT item_id, {_TOK.format('text')} AS l FROM benchmark)),\n"
         "qt AS (SELECT qid, term, count(*) AS boost, min(pos) AS pos FROM qtok GROUP BY ALL)")


def _scores(name: str, k1: float, b: float, factor: float) -> str:
    return f"""{name}_t AS MATERIALIZED (
  SELECT qid, p.doc_id, p.term, p.tf, d.df, w - w / (1 + p.tf * (1 / ({k1} * (1 - {b} + {b} * p.dl / avgdl)))) AS score
  FROM posts p JOIN (SELECT term, count(*) AS df FROM posts GROUP BY term) d ON p.term = d.term
  JOIN (SELECT qt.*, df, boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * {factor} AS w, avgdl
        FROM qt JOIN (SELECT term, count(*) AS df FROM posts GROUP BY term) USING (term), stats) q ON q.term = p.term),
{name}_s AS (SELECT qid, doc_id, round(sum(score), 6) AS score FROM {name}_t GROUP BY ALL),
{name} AS MATERIALIZED (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, score FROM {name}_s)"""


BASE = (DOCS, TOKENS, POSTS, STATS, TOPIC, _scores("lex", 0.9, 0.4, 1.9))
LEX = (*BASE, "lr AS (SELECT * FROM lex WHERE rank <= 100)")
DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _knn(name: str, score: str, where: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank, score
  FROM (SELECT a.vec_id AS qid, b.vec_id, round({score}, 6) AS score FROM embeddings a, embeddings b WHERE {where}))"""


DENSE = (_knn("nn", DOT, "a.vec_id IN (SELECT item_id FROM benchmark)"), "dr AS (SELECT qid, vec_id AS doc_id, rank, score FROM nn WHERE rank <= 100)")
QRELS = """qrels AS MATERIALIZED (
  SELECT qid, doc_id, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS grade
  FROM lr JOIN benchmark i ON i.item_id = qid JOIN documents d USING (doc_id)
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE contains(d.text, i.text))"""
NORMS = """ln_ AS (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi, avg(score) OVER q AS m, stddev_pop(score) OVER q AS sd FROM lr WINDOW q AS (PARTITION BY qid)),
dn AS (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi, avg(score) OVER q AS m, stddev_pop(score) OVER q AS sd FROM dr WINDOW q AS (PARTITION BY qid)),
ln AS (SELECT qid, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS minmax, CASE WHEN sd > 0 THEN (score - m) / sd ELSE 0.0 END AS zscore FROM ln_),
dd AS (SELECT qid, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS minmax, CASE WHEN sd > 0 THEN (score - m) / sd ELSE 0.0 END AS zscore FROM dn)"""


def _weighted(name: str, norm: str, alpha: float) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT qid, doc_id, round({alpha} * coalesce(d, min(d) OVER q, 0) + {1 - alpha} * coalesce(l, min(l) OVER q, 0), 6) AS score
  FROM (SELECT coalesce(ln.qid, dd.qid) AS qid, coalesce(ln.doc_id, dd.doc_id) AS doc_id, ln.{norm} AS l, dd.{norm} AS d
        FROM ln FULL JOIN dd ON ln.qid = dd.qid AND ln.doc_id = dd.doc_id) WINDOW q AS (PARTITION BY qid))"""


def _top(source: str, k: int = 10) -> str:
    return f"SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


EVAL = (*LEX, QRELS, "er AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id::VARCHAR DESC) AS rank FROM lr)", "judged AS (SELECT DISTINCT qid FROM qrels)")
FUSED = (*LEX, *DENSE, NORMS)
UI = """ui AS (
  SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'impression' ELSE event_type END AS type, 'u' || user_id AS session_id,
         'u' || user_id || '-' || strftime(ts, '%Y%m%d%H') AS request_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1 AS rank, CASE WHEN event_type = 'signup' THEN trunc(value)::BIGINT END AS dwell_ms,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END AS team, user_id FROM events)"""
PAGES = """seen AS (SELECT request_id, rank, min(session_id) AS session_id, max((type = 'impression')::INT) AS s, max((type = 'click')::INT) AS c
  FROM ui WHERE type IN ('impression', 'click') AND request_id IS NOT NULL GROUP BY ALL),
pages_ AS (SELECT * FROM (SELECT request_id, min(session_id) AS session_id, sum(s)::BIGINT AS shown, sum(s * c)::BIGINT AS clicks, min(CASE WHEN s * c = 1 THEN rank END) AS first,
  max((s * c = 1 AND rank = 1)::INT) AS clicked_at_1, sum((1 - s) * c)::BIGINT AS unserved FROM seen GROUP BY request_id) WHERE shown > 0)"""
METRICS = "metrics AS (SELECT request_id, session_id, clicks::DOUBLE AS clicks_per_impression, clicked_at_1::DOUBLE AS clicks_at_1, (clicks = 0)::INT::DOUBLE AS abandonment, coalesce(1.0 / first, 0.0)::DOUBLE AS rr_first FROM pages_)"
ARMS = "arms AS (SELECT *, CASE WHEN substr(session_id, 2)::BIGINT % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant FROM metrics)"
LOG = f"log AS (SELECT unnest({_TOK.format('text')}) AS query FROM conversations WHERE role = 'user'),\ncounts AS (SELECT query, count(*) AS n FROM log WHERE query <> '' GROUP BY query)"
CREDIT = """served AS (SELECT DISTINCT request_id, session_id, doc_id, team FROM ui WHERE type = 'impression'),
hits AS (SELECT DISTINCT request_id, session_id, doc_id, 1 AS hit FROM ui WHERE type = 'click'),
credit AS (SELECT *, CASE WHEN clicks_a > clicks_b THEN 'A' WHEN clicks_b > clicks_a THEN 'B' ELSE 'tie' END AS winner FROM (
  SELECT request_id, session_id, count(*) FILTER (hit = 1 AND team = 'A') AS clicks_a, count(*) FILTER (hit = 1 AND team = 'B') AS clicks_b
  FROM served LEFT JOIN hits USING (request_id, session_id, doc_id) GROUP BY ALL))"""
SWAPS = """swaps AS (SELECT rank, event_id % 2 AS swapped, (type = 'click')::INT::DOUBLE AS clicked FROM ui WHERE type IN ('impression', 'click')),
eta AS (SELECT rank, round(CASE WHEN rank = 1 THEN 1.0 WHEN at_1 > 0 THEN at_k / at_1 END, 6)::DOUBLE AS eta FROM (
  SELECT rank, avg(clicked) FILTER (swapped = 1) AS at_k, avg(clicked) FILTER (swapped = 0) AS at_1 FROM swaps GROUP BY rank))"""
def _two(w: str) -> str:
    """All strings with up to two characters of the first seven deleted, as a list."""
    one = "list_transform(range(1, len({0}) + 1), lambda {1}: substr({0}, 1, {1} - 1) || substr({0}, {1} + 1, 7))"
    head = f"substr({w}, 1, 7)"
    return f"list_distinct([{head}] || {one.format(head, 'i')} || flatten(list_transform({one.format(head, 'i')}, lambda v: {one.format('v', 'j')})))"


LEX10 = "SELECT qid, doc_id, rank, score FROM lr WHERE rank <= 10"
SHARES = f"""tops AS (SELECT qid, doc_id FROM lr WHERE rank <= 10), qs AS (SELECT DISTINCT qid, term FROM qt), ds AS (SELECT DISTINCT doc_id, term FROM posts WHERE doc_id IN (SELECT doc_id FROM tops)),
shares AS (SELECT t.qid, t.doc_id, round(count(ds.term)::DOUBLE / count(*), 6) AS rerank FROM tops t JOIN qs USING (qid) LEFT JOIN ds ON ds.doc_id = t.doc_id AND ds.term = qs.term GROUP BY ALL)"""
_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_CROCK = " || ".join(f"substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', (((epoch_us(ts) // 1000) >> {5 * k}) % 32 + 1)::INT, 1)" for k in range(9, -1, -1))

ORACLES = {
    "term_lookup": _ctes(DOCS, TOKENS, POSTS, TOPIC) + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts WHERE term IN (SELECT term FROM qt) GROUP BY term",
    "fetch_texts": _ctes(*BASE) + "SELECT qid, doc_id, rank, length(text) AS n_chars, md5(text) AS md5 FROM lex JOIN documents USING (doc_id) WHERE rank <= 10",
    "query_instruction": r"SELECT item_id AS qid, 'query: ' || array_to_string(string_split_regex(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')[1:16], ' ') AS prompt FROM benchmark",
    "selected_scores": _ctes(*LEX, *DENSE) + "SELECT c.qid, c.doc_id, coalesce(s.score, 0.0)::DOUBLE AS score FROM (SELECT DISTINCT qid, doc_id FROM dr WHERE rank <= 20) c LEFT JOIN lex_s s USING (qid, doc_id)",
    "rerank_pool": _ctes(*LEX, *DENSE) + "SELECT qid, doc_id FROM lr WHERE rank <= 20 UNION SELECT qid, doc_id FROM dr WHERE rank <= 20",
    "mode_fallback": _ctes(*FUSED, _weighted("f", "zscore", 0.8), "m AS (SELECT item_id AS qid, CASE WHEN item_id % 3 > 0 AND item_id IN (SELECT qid FROM dr) THEN CASE item_id % 3 WHEN 1 THEN 'dense' ELSE 'hybrid' END ELSE 'lexical' END AS mode FROM benchmark)",
                           f"hy AS ({_top('f')})")
    + "SELECT qid, mode, doc_id, rank, score FROM lr JOIN m USING (qid) WHERE mode = 'lexical' AND rank <= 10 UNION ALL SELECT qid, mode, doc_id, rank, score FROM dr JOIN m USING (qid) WHERE mode = 'dense' AND rank <= 10 "
      "UNION ALL SELECT qid, mode, doc_id, rank, score FROM hy JOIN m USING (qid) WHERE mode = 'hybrid'",
    "progressive_result": _ctes(*FUSED, _weighted("f", "zscore", 0.8)) + f"SELECT 'lexical' AS stage, * FROM ({LEX10}) UNION ALL SELECT 'final', * FROM ({_top('f')})",
    "rerank_scores": _ctes(*LEX, SHARES) + "SELECT * FROM shares",
    "align_values": _ctes(*EVAL, "ideal AS (SELECT qid, sum(grade / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS i FROM qrels) WHERE i <= 10 GROUP BY qid)",
                          "got AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg, min(rank) AS r FROM er JOIN qrels USING (qid, doc_id) WHERE rank <= 10 GROUP BY qid)")
    + "SELECT qid, round(coalesce(1.0::DOUBLE / r, 0), 6) AS a, round(coalesce(dcg / ideal, 0), 6) AS b FROM judged LEFT JOIN ideal USING (qid) LEFT JOIN got USING (qid)",
    "export_parity": _ctes(*BASE, _scores("luc", 1.2, 0.75, 1.0), *[f"{n} AS (SELECT qid, doc_id, score, rank FROM {r} WHERE rank <= 10)" for n, r in (("x", "lex"), ("y", "luc"))],
                           "b AS (SELECT qid, x.score AS sx, y.score AS sy, x.rank AS rx, y.rank AS ry FROM x JOIN y USING (qid, doc_id))")
    + "SELECT qid, count(*) AS n, round(max(abs(sx - sy)), 6) AS max_diff, max(abs(rx - ry)) = 0 AS same_order FROM b GROUP BY qid",
    "suggest_lookup": _ctes(LOG, TOPIC, "asked AS (SELECT DISTINCT substr(term, 1, 3) AS prefix FROM qt)")
    + "SELECT prefix, rank, query, n, len(prefix)::INT AS span_end FROM (SELECT prefix, query, n, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, query) AS rank FROM asked JOIN counts ON starts_with(query, prefix)) WHERE rank <= 5",
    "ulid_times": f"SELECT event_id, {_CROCK} AS time_part FROM events",
    "team_balance": _ctes(UI, "t AS (SELECT DISTINCT request_id, team FROM ui WHERE type = 'impression' AND rank = 1)", "c AS (SELECT count(*) FILTER (team = 'A') AS n_a, count(*) FILTER (team = 'B') AS n_b FROM t)")
    + "SELECT n_a, n_b, CASE WHEN n_a + n_b > 0 THEN round((n_a - n_b) / sqrt(n_a + n_b), 6) END AS z FROM c",
    "request_validate": f"""WITH q AS (SELECT event_id, {_K} AS x FROM events),
r AS (SELECT event_id, CASE WHEN x % 7 > 0 THEN repeat('ab', x * 4) ELSE '' END AS q, CASE WHEN x % 5 > 0 THEN x + 5 ELSE 10 END AS k, CASE WHEN x % 3 > 0 THEN ['lexical', 'dense', 'hybrid', 'other'][x % 4 + 1] ELSE 'hybrid' END AS mode FROM q)
SELECT event_id, k, mode, CASE WHEN q = '' OR len(q) > 512 THEN 'q' WHEN k NOT BETWEEN 1 AND 100 THEN 'k' WHEN mode = 'other' THEN 'mode' END AS error FROM r""",
    "dense_for_candidates": _ctes(*LEX, f"c AS (SELECT qid, doc_id, round({DOT}, 6) AS score FROM lr JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = doc_id)")
    + "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, score FROM c",
    "list_ndcg": _ctes(*EVAL, SHARES, "ideal AS (SELECT qid, sum(grade / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS i FROM qrels) WHERE i <= 10 GROUP BY qid)",
                       "sr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, doc_id) AS rank FROM shares)", "got AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg FROM sr JOIN qrels USING (qid, doc_id) WHERE rank <= 10 GROUP BY qid)")
    + "SELECT qid, round(coalesce(dcg / ideal, 0), 6) AS value FROM judged LEFT JOIN ideal USING (qid) LEFT JOIN got USING (qid)",
    "stream_first_seen": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "tokens_tf": _ctes(DOCS, TOKENS, POSTS) + "SELECT doc_id, term, tf FROM posts",
    "lexicon": _ctes(DOCS, TOKENS, POSTS) + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY term",
    "collection_stats": _ctes(DOCS, STATS) + "SELECT n_docs, sum_dl, round(avgdl, 6) AS avgdl FROM stats",
    "query_terms": _ctes(TOPIC) + "SELECT * FROM qt",
    "bm25_topk": _ctes(*BASE) + "SELECT * FROM lex WHERE rank <= 10",
    "bm25_pruned": _ctes(*BASE) + "SELECT * FROM lex WHERE rank <= 10",
    "bm25_sharded": _ctes(*BASE) + "SELECT * FROM lex WHERE rank <= 10",
    "bm25_idf_only": _ctes(DOCS, TOKENS, POSTS, STATS, TOPIC, _scores("luc", 1.2, 0.75, 1.0)) + "SELECT * FROM luc WHERE rank <= 10",
    "bm25_explain": _ctes(*BASE) + "SELECT t.qid, t.doc_id, lex.rank, term, tf, df, round(t.score, 6) AS score, round(t.score / lex.score, 4) AS share FROM lex_t t JOIN lex USING (qid, doc_id) WHERE rank <= 10",
    "term_bounds": _ctes(DOCS, TOKENS, POSTS, STATS) + "SELECT term, count(*) AS df, max(tf) AS max_tf, min(dl) AS min_dl, round(max(tf / (0.9 * (0.6 + 0.4 * dl / avgdl))), 6) AS max_gain FROM posts, stats GROUP BY term",
    "highlight_merge": _ctes(UI, "s AS (SELECT session_id AS id, doc_id AS start, doc_id + doc_id % 7 + 1 AS stop FROM ui)",
                             "f AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < start AS fresh FROM s)",
                             "g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM f)")
    + 'SELECT id, min(start) AS start, max(stop) AS "end" FROM g GROUP BY id, island',
    "harvest_ratios": _ctes(UI, "e AS (SELECT *, event_id % 2 AS logger FROM ui WHERE type IN ('impression', 'click'))",
                            "p AS (SELECT logger, doc_id, CASE WHEN logger = 0 THEN doc_id % 10 + 1 ELSE doc_id % 7 + 1 END AS rank, count(*) FILTER (type = 'click') AS clicks, count(*) AS sessions FROM e GROUP BY ALL)",
                            "m AS (SELECT a.rank AS r, b.rank AS s, sum(a.clicks) AS c, sum(a.sessions) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.logger <> b.logger AND a.rank <> b.rank GROUP BY ALL)")
    + "SELECT x.r, x.s, round(ln(x.c / x.n) - ln(y.c / y.n), 6) AS log_ratio, round(1 / (1 / x.c + 1 / y.c), 6) AS weight FROM m x JOIN m y ON x.r = y.s AND x.s = y.r WHERE x.r < x.s AND x.c > 0 AND y.c > 0",
    "degradation_notice": """WITH q AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(value, 0) AS v FROM events),
r AS (SELECT *, k % 2 = 0 AND k % 11 > 0 AND k % 13 > 0 AS d, k % 3 > 0 AND k % 17 > 0 AS rr, CASE WHEN k > 95 THEN 3 WHEN k > 75 THEN 2 WHEN k > 50 THEN 1 ELSE 0 END AS f, v * 4 AS rem, k % 29 = 0 AS probe FROM q),
c AS (SELECT *, CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN d THEN v * 0.9 ELSE v * 0.3 END + CASE WHEN rr THEN v * 3.0 ELSE 0 END + 2 AS c0,
      CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN d THEN v * 0.9 ELSE v * 0.3 END + 2 AS c1, CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN d THEN v * 0.5 ELSE v * 0.3 END + 2 AS c2 FROM r),
l AS (SELECT *, CASE WHEN f <= 0 AND (probe OR c0 <= rem) THEN 0 WHEN f <= 1 AND (probe OR c1 <= rem) THEN 1 WHEN f <= 2 AND (probe OR c2 <= rem) THEN 2 ELSE 3 END AS level FROM c)
SELECT level, ['', 'Results are not reranked.', 'Results are searched less deeply.', 'Results are matched by words only.'][level + 1] AS notice, count(*) AS n FROM l GROUP BY ALL""",
    "degradation_plan": """WITH q AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(value, 0) AS v FROM events),
r AS (SELECT *, k % 2 = 0 AND k % 11 > 0 AND k % 13 > 0 AS d, k % 3 > 0 AND k % 17 > 0 AS rr, CASE WHEN k > 95 THEN 3 WHEN k > 75 THEN 2 WHEN k > 50 THEN 1 ELSE 0 END AS f, v * 4 AS rem, k % 29 = 0 AS probe FROM q),
c AS (SELECT *, CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN d THEN v * 0.9 ELSE v * 0.3 END + CASE WHEN rr THEN v * 3.0 ELSE 0 END + 2 AS c0,
      CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN d THEN v * 0.9 ELSE v * 0.3 END + 2 AS c1, CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN d THEN v * 0.5 ELSE v * 0.3 END + 2 AS c2 FROM r),
l AS (SELECT *, CASE WHEN f <= 0 AND (probe OR c0 <= rem) THEN 0 WHEN f <= 1 AND (probe OR c1 <= rem) THEN 1 WHEN f <= 2 AND (probe OR c2 <= rem) THEN 2 ELSE 3 END AS level FROM c)
SELECT level, d AND level < 3 AS use_dense, d AND level = 2 AS shrink_beam, rr AND level < 1 AS use_rerank, k % 5 > 0 OR NOT (d AND level < 3) AS use_lexical, count(*) AS n FROM l GROUP BY ALL""",
    "rolling_latency": "SELECT start, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM (SELECT value, unnest(list_transform(range(6), lambda i: time_bucket(INTERVAL 10 SECOND, ts) - i::INT * INTERVAL 10 SECOND)) AS start FROM events WHERE value IS NOT NULL) GROUP BY start",
    "dwell_times": _ctes(UI) + "SELECT session_id, event_id, dwell_us FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)) - epoch_us(ts) AS dwell_us FROM ui) WHERE type = 'click'",
    "abandoned_pages": _ctes(UI, PAGES) + "SELECT request_id FROM pages_ WHERE clicks = 0",
    "availability": "WITH q AS (SELECT event_type AS phase, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(value, 0) AS v FROM events) SELECT phase, count(*) AS requests, round(avg((k % 10 = 0)::INT), 6) AS error_rate, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, "
    "round(sum((k % 10 <> 0 AND k % 4 - 2 > 0)::INT) / count(*)::DOUBLE, 6) AS degraded_rate, round(avg(CASE WHEN k % 10 <> 0 AND k % 3 > 0 THEN 1.0::DOUBLE / (k % 10 + 1) ELSE 0 END), 6) AS mrr FROM q GROUP BY phase",
    "score_agreement": _ctes(*BASE, _scores("luc", 1.2, 0.75, 1.0), "j AS (SELECT x.score AS x, y.score * 1.9 AS y FROM (SELECT * FROM lex WHERE rank <= 10) x FULL JOIN (SELECT * FROM luc WHERE rank <= 10) y USING (qid, doc_id))")
    + "SELECT count(x + y) AS pairs, count(x) - count(x + y) AS only_a, count(y) - count(x + y) AS only_b, count(*) FILTER (abs(round(x, 4) - round(y, 4)) <= 0.000101) AS within, round(max(abs(round(x, 4) - round(y, 4))), 6) AS largest FROM j",
    "document_shards": "SELECT doc_id % 4 AS shard, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1",
    "knn_exact": _ctes(_knn("nn", DOT, "a.vec_id % 100 = 0")) + "SELECT * FROM nn WHERE rank <= 10",
    "knn_sharded": _ctes(_knn("nn", DOT, "a.vec_id % 100 = 0")) + "SELECT * FROM nn WHERE rank <= 10",
    "knn_l2": _ctes(_knn("nn", "-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))", "a.vec_id % 100 = 0")) + "SELECT * FROM nn WHERE rank <= 10",
    "medoid": "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i) SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS distance FROM e JOIN m USING (i) GROUP BY vec_id ORDER BY distance, vec_id LIMIT 1",
    "l2_normalise": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3::FLOAT)::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM e) SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / s) * (x / s))), 6) AS norm, round(v[1] / s, 6) AS first FROM n",
    "fusion_rrf": _ctes(*LEX, *DENSE, "f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT qid, doc_id, rank FROM lr UNION ALL SELECT qid, doc_id, rank FROM dr) GROUP BY ALL)") + _top("f"),
    "fusion_minmax": _ctes(*FUSED, _weighted("f", "minmax", 0.5)) + _top("f"),
    "depth_matched": _ctes(*BASE, "lr AS (SELECT * FROM lex WHERE rank <= 20)", DENSE[0], "dr AS (SELECT qid, vec_id AS doc_id, rank, score FROM nn WHERE rank <= 20)", *DENSE[2:], NORMS, _weighted("f", "zscore", 0.8)) + _top("f"),
    "fusion_zscore": _ctes(*FUSED, _weighted("f", "zscore", 0.8)) + _top("f"),
    "fusion_grid": _ctes(*FUSED, QRELS, *[_weighted(f"{n}_{i}", n, a) for n in ("minmax", "zscore") for i, a in enumerate((0.2, 0.5, 0.8))],
                         "every AS (" + " UNION ALL ".join(f"SELECT '{n}-{a}' AS config, * FROM {n}_{i}" for n in ("minmax", "zscore") for i, a in enumerate((0.2, 0.5, 0.8))) + ")")
    + "SELECT config, round(sum(grade / log2(rank + 1.0)), 6) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, doc_id) AS rank FROM every) JOIN qrels USING (qid, doc_id) WHERE rank <= 10 GROUP BY config",
    "rerank_cascade": _ctes(*BASE) + "SELECT qid, lex.doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank <= 5 DESC, CASE WHEN rank <= 5 THEN dl END DESC NULLS LAST, rank) AS new_rank FROM lex JOIN docs USING (doc_id) WHERE rank <= 10",
    "eval_mrr": _ctes(*EVAL) + "SELECT qid, round(coalesce(1.0::DOUBLE / r, 0), 6) AS value FROM judged LEFT JOIN (SELECT qid, min(rank) AS r FROM er JOIN qrels USING (qid, doc_id) WHERE rank <= 10 GROUP BY qid) USING (qid)",
    "eval_ndcg": _ctes(*EVAL, "ideal AS (SELECT qid, sum(grade / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS i FROM qrels) WHERE i <= 10 GROUP BY qid)",
                       "got AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg FROM er JOIN qrels USING (qid, doc_id) WHERE rank <= 10 GROUP BY qid)")
    + "SELECT qid, round(coalesce(dcg / ideal, 0), 6) AS value FROM judged LEFT JOIN ideal USING (qid) LEFT JOIN got USING (qid)",
    "eval_recall": _ctes(*EVAL) + "SELECT qid, round(coalesce(v, 0), 6) AS value FROM judged LEFT JOIN (SELECT qid, count(er.doc_id) / count(*)::DOUBLE AS v FROM qrels LEFT JOIN (SELECT * FROM er WHERE rank <= 10) er USING (qid, doc_id) WHERE grade >= 2 GROUP BY qid) USING (qid)",
    "overlap_at_k": _ctes(*FUSED, _weighted("f", "zscore", 0.8), f"t AS ({_top('f')})")
    + "SELECT qid, round(coalesce(n, 0) / 10.0::DOUBLE, 6) AS overlap FROM (SELECT qid FROM lex WHERE rank <= 10 UNION SELECT qid FROM t) LEFT JOIN (SELECT qid, count(*) AS n FROM lex JOIN t USING (qid, doc_id) WHERE lex.rank <= 10 GROUP BY qid) USING (qid)",
    "parity_buckets": _ctes(*BASE, _scores("luc", 1.2, 0.75, 1.0), *[f"{n} AS (SELECT qid, list(doc_id ORDER BY rank) AS ids, min(score) AS last FROM {r} WHERE rank <= 10 GROUP BY qid)" for n, r in (("x", "lex"), ("y", "luc"))])
    + "SELECT qid, CASE WHEN x.ids = y.ids THEN 'identical' WHEN list_sort(x.ids) = list_sort(y.ids) THEN 'tie_order' WHEN x.last = y.last THEN 'tie_cutoff' ELSE 'different' END AS bucket FROM x FULL JOIN y USING (qid)",
    "holm": "WITH c AS (SELECT c_mktsegment AS name, (sum(c_custkey) % 1000)::BIGINT / 10000.0::DOUBLE AS p FROM customer GROUP BY 1), s AS (SELECT name, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS v FROM c) SELECT name, p, round(max(v) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS p_holm FROM s",
    "query_counts": _ctes(LOG) + "SELECT * FROM counts",
    "suggest_prefix": _ctes(LOG, "p AS (SELECT substr(query, 1, l) AS prefix, query, n FROM (SELECT *, unnest(range(0, len(query) + 1)) AS l FROM counts))")
    + "SELECT prefix, rank, query, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, query) AS rank FROM p) WHERE rank <= 5",
    "spell_candidates": _ctes(LOG, "known AS (SELECT query AS word, n FROM counts WHERE n >= 3)", TOPIC, "asked AS (SELECT DISTINCT term AS word FROM qt WHERE term NOT IN (SELECT word FROM known))",
                              f"x AS (SELECT DISTINCT word, unnest({_two('word')}) AS key FROM asked WHERE regexp_full_match(word, '[a-z]{{3,30}}'))", f"y AS (SELECT DISTINCT word AS candidate, n, unnest({_two('word')}) AS key FROM known WHERE regexp_full_match(word, '[a-z]{{3,30}}'))")
    + "SELECT DISTINCT word, candidate, n FROM x JOIN y USING (key) WHERE word <> candidate",
    "event_validate": _ctes(UI) + "SELECT coalesce(CASE WHEN type IS NULL OR type NOT IN ('impression', 'click', 'dwell', 'query', 'abandon') THEN 'type' WHEN NOT regexp_full_match(coalesce(session_id, ''), '[A-Za-z0-9_-]{1,128}') THEN 'session_id' WHEN doc_id IS NULL OR doc_id < 0 THEN 'doc_id' WHEN rank NOT BETWEEN 1 AND 1000 THEN 'rank' END, 'ok') AS error, type, count(*) AS n FROM ui GROUP BY ALL",
    "page_reconstruct": _ctes(UI, PAGES) + "SELECT * FROM pages_",
    "impression_metrics": _ctes(UI, PAGES, METRICS) + "SELECT * REPLACE (round(rr_first, 6) AS rr_first) FROM metrics",
    "ab_report": _ctes(UI, PAGES, METRICS, ARMS, "l AS (UNPIVOT arms ON clicks_per_impression, clicks_at_1, abandonment, rr_first INTO NAME metric VALUE x)",
                       "g AS (SELECT metric, count(x) FILTER (variant = 'control') AS n_a, count(x) FILTER (variant = 'treatment') AS n_b, avg(x) FILTER (variant = 'control') AS a, avg(x) FILTER (variant = 'treatment') AS b, var_samp(x) FILTER (variant = 'control') AS va, var_samp(x) FILTER (variant = 'treatment') AS vb FROM l GROUP BY metric)")
    + "SELECT metric, n_a, n_b, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(b - a, 6) AS delta, CASE WHEN va / n_a + vb / n_b > 0 THEN round((b - a) / sqrt(va / n_a + vb / n_b), 6) END AS z FROM g",
    "srm_check": _ctes(UI, PAGES, METRICS, ARMS, "c AS (SELECT variant, count(DISTINCT session_id) AS n FROM arms GROUP BY variant)")
    + "SELECT sum(n)::BIGINT AS n, count(*) AS arms, round(sum(n::DOUBLE * n) / (sum(n) / count(*)) - sum(n), 6) AS chi2 FROM c",
    "interleave_credit": _ctes(UI, CREDIT) + "SELECT * FROM credit",
    "interleave_report": _ctes(UI, CREDIT, "s AS (SELECT count(*) AS impressions, count(*) FILTER (winner = 'A') AS wins_a, count(*) FILTER (winner = 'B') AS wins_b, count(*) FILTER (winner = 'tie' AND clicks_a > 0) AS clicked_ties FROM credit)")
    + "SELECT *, round((wins_a + 0.5::DOUBLE * (impressions - wins_a - wins_b)) / impressions - 0.5, 6) AS delta_ab, CASE WHEN wins_a + wins_b + clicked_ties > 0 THEN round((wins_b - wins_a) / (wins_a + wins_b + clicked_ties)::DOUBLE, 6) END AS delta_clicked FROM s",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "slo_burn": "SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS rate FROM (SELECT event_type, unnest(list_transform(range(12), lambda i: time_bucket(INTERVAL 5 MINUTE, ts) - i::INT * INTERVAL 5 MINUTE)) AS start FROM events) GROUP BY start",
    "session_ratio": _ctes(UI, PAGES) + "SELECT session_id, sum(clicks)::BIGINT AS clicks, sum(shown)::BIGINT AS shown, round(sum(clicks) / sum(shown)::DOUBLE, 6) AS ratio FROM pages_ GROUP BY session_id",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, quantile_disc(value, 0.99) AS p99_nearest FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "ltr_features": _ctes(*LEX, *DENSE, f"qw AS (SELECT item_id AS qid, len({_TOK.format('text')}) AS nw FROM benchmark)",
                          *[f"{n}s AS (SELECT qid, avg(score) AS m, stddev_pop(score) + 1e-9 AS sd, min(score) AS lo FROM {r} GROUP BY qid)" for n, r in (("l", "lr"), ("d", "dr"))],
                          "z AS (SELECT c.qid, c.doc_id, coalesce((l.score - ls.m) / ls.sd, (ls.lo - ls.m) / ls.sd - 0.5, -0.5) AS zl, coalesce((d.score - ds.m) / ds.sd, (ds.lo - ds.m) / ds.sd - 0.5, -0.5) AS zd, l.rank AS rl, d.rank AS rd, coalesce(dl, 0) AS dl, ln(1 + coalesce(nw, 0)) AS w "
                          "FROM (SELECT * FROM lr WHERE rank <= 20) c LEFT JOIN lr l USING (qid, doc_id) LEFT JOIN dr d USING (qid, doc_id) LEFT JOIN ls ON ls.qid = c.qid LEFT JOIN ds ON ds.qid = c.qid LEFT JOIN docs ON docs.doc_id = c.doc_id LEFT JOIN qw ON qw.qid = c.qid)")
    + "SELECT qid, doc_id, round(zl, 6) AS z_lexical, round(zd, 6) AS z_dense, round(coalesce(1.0::DOUBLE / rl, 0), 6) AS rr_lexical, round(coalesce(1.0::DOUBLE / rd, 0), 6) AS rr_dense, round(ln(1 + dl), 6) AS log_length, round(w * zl, 6) AS words_lexical, round(w * zd, 6) AS words_dense FROM z",
    "ips_weights": _ctes(UI, "c AS (SELECT 'all' AS qid, doc_id, rank, count(*) AS clicks FROM ui WHERE type = 'click' GROUP BY ALL)")
    + "SELECT qid, doc_id, sum(clicks)::BIGINT AS naive, round(sum(clicks * least(1 / (1.0::DOUBLE / rank), 5.0)), 6) AS weight FROM c WHERE rank BETWEEN 1 AND 10 GROUP BY ALL",
    "propensity_swap": _ctes(UI, SWAPS) + "SELECT * FROM eta",
    "propensity_filled": _ctes(UI, SWAPS) + "SELECT rank, greatest(coalesce(last_value(CASE WHEN eta > 0 THEN eta END IGNORE NULLS) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING), 1.0), 0.001)::DOUBLE AS eta FROM eta WHERE rank <> 4",
    "hard_negatives": _ctes(*LEX, *DENSE, QRELS, *[f"{n}b AS (SELECT qid, max(score) AS best FROM {r} JOIN qrels USING (qid, doc_id) GROUP BY qid)" for n, r in (("l", "lr"), ("d", "dr"))],
                            "pool AS (SELECT qid, doc_id, 'lexical' AS source FROM lr WHERE rank <= 30 UNION ALL SELECT qid, doc_id, 'dense' FROM dr WHERE rank <= 30)")
    + "SELECT p.qid, p.doc_id, source FROM pool p LEFT JOIN lr l USING (qid, doc_id) LEFT JOIN dr d USING (qid, doc_id) LEFT JOIN lb ON lb.qid = p.qid LEFT JOIN db ON db.qid = p.qid WHERE NOT EXISTS (SELECT 1 FROM qrels r WHERE r.qid = p.qid AND r.doc_id = p.doc_id) AND NOT coalesce(d.score >= db.best AND l.score >= lb.best, false)",
    "click_within_hour": "SELECT v.event_id, c.event_id AS click_id, v.user_id FROM events v JOIN events c ON v.user_id = c.user_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND c.event_type = 'click'",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) GROUP BY ALL",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "top_orders_per_customer": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
}
for _stream, _batch in (("stream_hourly", "hourly_counts"), ("stream_slo_burn", "slo_burn"), ("stream_click_join", "click_within_hour")):
    ORACLES[_stream] = ORACLES[_batch]
