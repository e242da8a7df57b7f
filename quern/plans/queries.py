"""Every registered query: operators applied to the driver's tables, whole tables and whole texts.

Bindings: collection = documents; queries = benchmark items (qid = item_id); dense vectors = embeddings (doc_id = vec_id);
judgements = pooled top-100 documents that contain the item, graded 2 where labelled good; query log = words of user turns;
event log = events (session = user, request = user and hour, view = impression, rank = 1 + props.k % 10, doc = props.k).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.storage import checkpoint_root, materialise
from quern.functions.text import LOWER, UPPER, instructed, normalise_query, simple_tokens, ulid
from quern.operators import evaluation as ev
from quern.operators import experiments as ex
from quern.operators import fusion as fu
from quern.operators import learning as le
from quern.operators import lexical as lx
from quern.operators import lucene as lu
from quern.operators import serving as sv
from quern.operators import simulation as si
from quern.operators import suggest as su
from quern.operators import vector as ve
from quern.session import table
from quern.streaming import live

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def topics(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


_STORED: dict = {}


def stored(spark, sf, name: str, build):
    """What ``build`` makes of the documents, made once a session and state of their files."""
    files = table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum("file_size"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
    key = (spark.sparkContext.applicationId, sf, name, *state)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def index(spark, sf) -> lx.Index:
    return stored(spark, sf, "index", lambda: lx.store_index(corpus(spark, sf), f"quern_{uuid.uuid4().hex}"))


def lexical_run(spark, sf, k=100) -> DataFrame:
    """The stored run of all topics; its first k ranks."""
    run = stored(spark, sf, "run", lambda: materialise(lx.bm25(index(spark, sf), topics(spark, sf), k=100), "lexical-run"))
    return run.filter(F.col("rank") <= k)


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def dense_run(spark, sf, k=100) -> DataFrame:
    """Topics with a vector of their id against all vectors."""
    asked = vectors(spark, sf).join(topics(spark, sf).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi")
    found = ve.knn_blocks(vectors(spark, sf), asked, k)
    return found.select("qid", F.col("vec_id").alias("doc_id"), "rank", "score")


def judgements(spark, sf) -> DataFrame:
    return stored(spark, sf, "judgements", lambda: materialise(_judgements(spark, sf), "judgements"))


def _judgements(spark, sf) -> DataFrame:
    pool = lexical_run(spark, sf).select("qid", "doc_id")
    good = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    items = topics(spark, sf).select("qid", F.col("text").alias("item"))
    held = pool.join(items, "qid").join(corpus(spark, sf), "doc_id").filter(F.contains("text", "item")).join(good, "doc_id", "left")
    return held.select("qid", "doc_id", F.when(F.col("quality") == 1, 2).otherwise(1).alias("grade"))


def log_words(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(F.explode(simple_tokens(F.col("text"))).alias("query"))


def ui_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "view", "impression").otherwise(F.col("event_type"))
    return e.select(
        "event_id", "ts", kind.alias("type"), F.concat(F.lit("u"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMddHH")).alias("request_id"), F.lit(None).cast("string").alias("query"),
        k.alias("doc_id"), (k % 10 + 1).alias("rank"), F.when(F.col("event_type") == "signup", F.col("value").cast("long")).alias("dwell_ms"),
        F.when(k % 2 == 0, "A").otherwise("B").alias("team"), F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("variant"))


def pages(spark, sf) -> DataFrame:
    return ex.pages_from_events(ui_events(spark, sf))


# Lexical

@query
def tokens_tf(spark, sf):
    return lx.postings(corpus(spark, sf))


@query
def lexicon(spark, sf):
    return index(spark, sf).terms.select("term", "df", "cf")


@query
def collection_stats(spark, sf):
    return lx.collection_stats(lx.doc_stats(corpus(spark, sf))).select("n_docs", "sum_dl", F.round("avgdl", 6).alias("avgdl"))


@query
def query_terms(spark, sf):
    return lx.query_terms(topics(spark, sf))


@query
def bm25_topk(spark, sf):
    return lx.bm25(index(spark, sf), topics(spark, sf), k=10)


@query
def bm25_idf_only(spark, sf):
    """The model without the (k1 + 1) factor, at other parameters."""
    return lx.bm25(index(spark, sf), topics(spark, sf), k=10, k1=1.2, b=0.75, model="lucene")


@query
def bm25_explain(spark, sf):
    return lx.explain(index(spark, sf), topics(spark, sf), k=10)


@query
def term_bounds(spark, sf):
    return lx.term_bounds(index(spark, sf))


@query
def bm25_pruned(spark, sf):
    return lx.pruned(index(spark, sf), topics(spark, sf), k=10)


@query
def pruning_counters(spark, sf):
    """Blocks and postings that the exhaustive and the pruned search score, by topic."""
    return lx.pruning_report(index(spark, sf), topics(spark, sf), k=10)


@query
def term_lookup(spark, sf):
    """Document frequencies of the topics' terms, from the stored index."""
    return lx.of_terms(index(spark, sf).terms, lx.query_terms(topics(spark, sf))).select("term", "df", "cf")


@query
def fetch_texts(spark, sf):
    """The stored texts of the ranked documents, by id."""
    return bm25_topk(spark, sf).join(corpus(spark, sf), "doc_id").select("qid", "doc_id", "rank", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


@query
def query_instruction(spark, sf):
    return topics(spark, sf).select("qid", instructed(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "), "query: ", 16).alias("prompt"))


@query
def selected_scores(spark, sf):
    """Exact scores of the dense run's documents for every topic."""
    return lx.selected(index(spark, sf), topics(spark, sf), dense_run(spark, sf, 20))


@query
def bm25_sharded(spark, sf):
    """Per-shard top k under global statistics, merged: equals the single index."""
    scores = lx.term_scores(index(spark, sf), topics(spark, sf)).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    shard = W.partitionBy("qid", F.pmod("doc_id", F.lit(4))).orderBy(F.desc("score"), "doc_id")
    local = scores.withColumn("r", F.row_number().over(shard)).filter("r <= 10").select("qid", "doc_id", "score")
    return fu.merge_top_k(local, 10).select("qid", "doc_id", "rank", "score")


@query
def bm25_lucene(spark, sf):
    return lu.bm25_exact(corpus(spark, sf), topics(spark, sf), 10)


@query
def snippets(spark, sf):
    return lu.snippets(lu.bm25_exact(corpus(spark, sf), topics(spark, sf), 10), corpus(spark, sf), topics(spark, sf)).select(
        "qid", "doc_id", "rank", "snippet", F.size("highlights").alias("n_highlights"))


@query
def highlight_merge(spark, sf):
    """Merged spans of made-up highlights: one of 1 + k % 7 characters at every event's k, by user."""
    e = ui_events(spark, sf).select(F.col("session_id").alias("id"), F.col("doc_id").alias("start"), (F.col("doc_id") + F.col("doc_id") % 7 + 1).alias("end"))
    return lu.merge_spans(e)


# Vectors

def _asked(spark, sf) -> DataFrame:
    return vectors(spark, sf).filter("vec_id % 100 = 0")


@query
def knn_exact(spark, sf):
    return ve.knn_blocks(vectors(spark, sf), _asked(spark, sf), 10)


@query
def knn_sharded(spark, sf):
    """Exact top k of four shards, merged: equals the global search."""
    found = None
    for shard in range(4):
        part = ve.knn_blocks(vectors(spark, sf).filter(F.pmod("vec_id", F.lit(4)) == shard), _asked(spark, sf), 10)
        found = part if found is None else found.unionByName(part)
    return ve.merge_slices(found.drop("rank"), 10).select("qid", "vec_id", "rank", "score")


@query
def knn_l2(spark, sf):
    return ve.knn_blocks(vectors(spark, sf), _asked(spark, sf), 10, "l2")


@query
def medoid(spark, sf):
    return ve.medoid(vectors(spark, sf))


@query
def l2_normalise(spark, sf):
    v = vectors(spark, sf).withColumn("unit", ve.l2_normalise(F.transform("embedding", lambda x: x * 3)))
    return v.select("vec_id", F.round(ve.dot(F.col("unit"), F.col("unit")), 6).alias("norm"), F.round(F.element_at("unit", 1), 6).alias("first"))


@query
def kmeans_sizes(spark, sf):
    v = vectors(spark, sf)
    return ve.assign(v, ve.kmeans(v, 10)).groupBy("cluster").agg(F.count("*").alias("n"))


def _recall(spark, sf, found):
    return ve.recall_at_k(found, knn_exact(spark, sf), 10)


@query
def ivf_pq_search(spark, sf):
    return ve.in_blocks(_asked(spark, sf), lambda block: ve.ivf_pq(vectors(spark, sf), block, 10))


@query
def ivf_pq_recall(spark, sf):
    return _recall(spark, sf, ivf_pq_search(spark, sf))


@query
def graph_search(spark, sf):
    return ve.in_blocks(_asked(spark, sf), lambda block: ve.graph_search(vectors(spark, sf), block, 10))


@query
def graph_recall(spark, sf):
    return _recall(spark, sf, graph_search(spark, sf))


# Fusion

def _fused(spark, sf, **kw):
    return fu.fuse(lexical_run(spark, sf), dense_run(spark, sf), k=10, **kw).select("qid", "doc_id", "rank", "score")


@query
def fusion_rrf(spark, sf):
    return _fused(spark, sf, method="rrf")


@query
def fusion_minmax(spark, sf):
    return _fused(spark, sf, norm="minmax", alpha=0.5)


@query
def fusion_zscore(spark, sf):
    return _fused(spark, sf)


@query
def fusion_grid(spark, sf):
    """Discounted gain of the top 10, summed over topics, of every configuration."""
    runs = fu.grid(lexical_run(spark, sf), dense_run(spark, sf), [0.2, 0.5, 0.8])
    order = W.partitionBy("config", "qid").orderBy(F.desc("score"), "doc_id")
    ranked = runs.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")
    gains = ranked.join(judgements(spark, sf), ["qid", "doc_id"]).groupBy("config").agg(F.round(F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)), 6).alias("dcg"))
    return gains


@query
def rerank_cascade(spark, sf):
    """The lexical top 10 whose head of 5 is reordered by document length (a stand-in for a model's score)."""
    run = lexical_run(spark, sf, 10)
    score = index(spark, sf).docs.select("doc_id", F.col("dl").cast("double").alias("rerank"))
    per = run.select("qid", "doc_id").join(score, "doc_id")
    return fu.cascade(run, per, 5).select("qid", "doc_id", "rank", "new_rank")


@query
def rerank_pool(spark, sf):
    return fu.rerank_pool(lexical_run(spark, sf), dense_run(spark, sf), depth=20)


@query
def mode_fallback(spark, sf):
    """Every third topic asks for each mode; topics without a vector fall back to lexical."""
    modes = topics(spark, sf).select("qid", F.element_at(F.array(F.lit("lexical"), F.lit("dense"), F.lit("hybrid")), (F.col("qid") % 3 + 1).cast("int")).alias("mode"))
    return fu.by_mode(modes, lexical_run(spark, sf), dense_run(spark, sf))


@query
def depth_matched(spark, sf):
    """Fusion of lists cut to the same depth of 20."""
    return _fused(spark, sf, depth=20)


@query
def progressive_result(spark, sf):
    return fu.progressive(lexical_run(spark, sf, 10), _fused(spark, sf))


def token_share():
    """A stand-in for a model: the share of the query's distinct tokens that the text holds."""
    import re

    def score(queries, texts):
        sets = [[set(re.findall("[a-z0-9]+", x.translate(str.maketrans(UPPER, LOWER)))) for x in side] for side in (queries, texts)]
        return [len(q & t) / len(q) if q else 0.0 for q, t in zip(*sets, strict=True)]

    return score


@query
def rerank_scores(spark, sf):
    pairs = lexical_run(spark, sf, 10).select("qid", "doc_id").join(topics(spark, sf).select("qid", F.col("text").alias("query")), "qid").join(corpus(spark, sf), "doc_id")
    return fu.score_pairs(pairs, token_share).withColumn("rerank", F.round("rerank", 6))


# Evaluation

@query
def align_values(spark, sf):
    """RR and nDCG of the lexical run side by side, over the same topics."""
    run, j = ev.evaluator_order(lexical_run(spark, sf)), judgements(spark, sf)
    return ev.aligned(ev.reciprocal_rank(run, j), ev.ndcg(run, j))


@query
def export_parity(spark, sf):
    return ev.export_parity(bm25_topk(spark, sf), bm25_idf_only(spark, sf))


@query
def bootstrap_means(spark, sf):
    return ev.bootstrap_means(table(spark, sf, "events").select(F.col("event_type").alias("name"), "value"))


@query
def eval_mrr(spark, sf):
    return ev.reciprocal_rank(ev.evaluator_order(lexical_run(spark, sf)), judgements(spark, sf))


@query
def eval_ndcg(spark, sf):
    return ev.ndcg(ev.evaluator_order(lexical_run(spark, sf)), judgements(spark, sf))


@query
def eval_recall(spark, sf):
    return ev.recall(ev.evaluator_order(lexical_run(spark, sf)), judgements(spark, sf), 10, 2)


@query
def overlap_at_k(spark, sf):
    return ev.overlap(lexical_run(spark, sf, 10), _fused(spark, sf))


@query
def parity_buckets(spark, sf):
    return ev.parity(bm25_topk(spark, sf), bm25_idf_only(spark, sf))


@query
def holm(spark, sf):
    """Adjusted p of one comparison a market segment (a bounded family)."""
    c = table(spark, sf, "customer").groupBy("c_mktsegment").agg((F.pmod(F.sum(F.col("c_custkey")), F.lit(1000)) / 10000.0).alias("p"))
    return ev.holm(c.select(F.col("c_mktsegment").alias("name"), "p"))


@query
def randomization_test(spark, sf):
    j = judgements(spark, sf)
    a = ev.ndcg(ev.evaluator_order(lexical_run(spark, sf)), j).withColumnRenamed("value", "a")
    b = ev.ndcg(fu.fuse(lexical_run(spark, sf), dense_run(spark, sf), k=100), j).withColumnRenamed("value", "b")
    return ev.paired_tests(a.join(b, "qid").withColumn("name", F.lit("fused vs lexical")))


# Suggestion and spelling

@query
def query_counts(spark, sf):
    return su.query_counts(log_words(spark, sf))


@query
def suggest_prefix(spark, sf):
    return su.completions(su.query_counts(log_words(spark, sf)), k=5)


def _spelling(spark, sf):
    known = su.query_counts(log_words(spark, sf)).select(F.col("query").alias("word"), "n")
    asked = topics(spark, sf).select(F.explode(simple_tokens(F.col("text"))).alias("word")).distinct()
    return asked, known


@query
def spell_candidates(spark, sf):
    asked, known = _spelling(spark, sf)
    known = known.filter("n >= 3")
    return su.spell_candidates(asked.join(known.select("word"), "word", "left_anti"), known)


@query
def spell_correct(spark, sf):
    return su.correct(*_spelling(spark, sf))


@query
def suggest_lookup(spark, sf):
    """Completions of the first three letters of the topics' words."""
    asked = topics(spark, sf).select(F.explode(simple_tokens(F.col("text"))).alias("w")).select(F.substring("w", 1, 3).alias("prefix"))
    found = su.lookup(su.query_counts(log_words(spark, sf)), asked, 5)
    return found.select("prefix", "rank", "query", "n", su.prefix_span(F.col("prefix"), F.col("query"))["end"].alias("span_end"))


def _suggestions(spark, sf):
    words = topics(spark, sf).select("qid", F.posexplode(simple_tokens(F.col("text"))).alias("pos", "word"))
    return su.suggest_queries(words, su.correct(*_spelling(spark, sf)))


@query
def suggest_whole_query(spark, sf):
    return _suggestions(spark, sf)


@query
def did_you_mean(spark, sf):
    asked = topics(spark, sf).select("qid", normalise_query(F.col("text")).alias("query"))
    return su.did_you_mean(_suggestions(spark, sf), asked, log_words(spark, sf))


# Events and experiments

@query
def ulid_times(spark, sf):
    """The time part of every event's id, which sorts as its time does."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.substring(ulid(F.col("ts").cast("timestamp"), "event_id"), 1, 10).alias("time_part"))


@query
def team_balance(spark, sf):
    return ex.team_balance(ui_events(spark, sf).filter("type = 'impression'"))


@query
def request_validate(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    asked = table(spark, sf, "events").select("event_id", F.when(k % 7 > 0, F.repeat(F.lit("ab"), k * 4)).alias("q"), F.when(k % 5 > 0, k + 5).alias("k"),
                                              F.when(k % 3 > 0, F.element_at(F.array(F.lit("lexical"), F.lit("dense"), F.lit("hybrid"), F.lit("other")), k % 4 + 1)).alias("mode"))
    return sv.validate_requests(asked).select("event_id", "k", "mode", "error")


@query
def event_validate(spark, sf):
    return ex.validate_events(ui_events(spark, sf)).groupBy(F.coalesce("error", F.lit("ok")).alias("error"), "type").agg(F.count("*").alias("n"))


@query
def page_reconstruct(spark, sf):
    return pages(spark, sf)


@query
def impression_metrics(spark, sf):
    m = ex.impression_metrics(pages(spark, sf))
    return m.select("request_id", "session_id", "clicks_per_impression", "clicks_at_1", "abandonment", F.round("rr_first", 6).alias("rr_first"))


def _arms(spark, sf):
    m = ex.impression_metrics(pages(spark, sf))
    return m.withColumn("variant", F.when(F.substring("session_id", 2, 20).cast("long") % 2 == 0, "control").otherwise("treatment"))


@query
def ab_report(spark, sf):
    return ex.ab_report(_arms(spark, sf))


@query
def srm_check(spark, sf):
    return ex.srm(_arms(spark, sf).groupBy("variant").agg(F.countDistinct("session_id").alias("n")))


def _credit(spark, sf):
    e = ui_events(spark, sf)
    served = e.filter("type = 'impression'").select("request_id", "session_id", "doc_id", "team").distinct()
    return ex.interleave_credit(served, e.filter("type = 'click'"))


@query
def interleave_credit(spark, sf):
    return _credit(spark, sf)


@query
def interleave_report(spark, sf):
    return ex.interleave_report(_credit(spark, sf))


@query
def hourly_counts(spark, sf):
    return live.hourly_counts(table(spark, sf, "events").select("ts", "event_type"))


@query
def slo_burn(spark, sf):
    return live.sliding_rates(table(spark, sf, "events").select("ts", "event_type"))


@query
def session_ratio(spark, sf):
    p = pages(spark, sf)
    return p.groupBy("session_id").agg(F.sum("clicks").alias("clicks"), F.sum("shown").alias("shown"), F.round(F.sum("clicks") / F.sum("shown"), 6).alias("ratio"))


@query
def session_ratio_interval(spark, sf):
    return ex.session_ratio_bootstrap(session_ratio(spark, sf).select("session_id", F.col("clicks").cast("double").alias("num"), F.col("shown").cast("double").alias("den")))


@query
def latency_percentiles(spark, sf):
    """Linear-interpolated and nearest-rank percentiles by event type."""
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"),
                                       F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99_nearest"))


@query
def assign_buckets(spark, sf):
    sessions = ui_events(spark, sf).select("session_id").distinct()
    return ex.assign(sessions, [{"id": "exp-1", "salt": "2026-09-23-a", "allocation": 0.2}, {"id": "exp-2", "salt": "s", "allocation": 0.5}])


@query
def team_draft(spark, sf):
    """Interleaved pages of the lexical and the dense run, one a topic."""
    best = lambda run, n: run.filter("rank <= 10").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x")).select("qid", F.col("x.doc_id").alias(n))
    both = best(lexical_run(spark, sf, 10), "a").join(best(dense_run(spark, sf, 10), "b"), "qid")
    return ex.interleave_pages(both.select(F.col("qid").cast("string").alias("request_id"), F.concat(F.lit("s"), "qid").alias("session_id"), F.col("qid").cast("string").alias("query"), "a", "b"), 10, "salt")


@query
def interleave_enumerate(spark, sf):
    """All outcomes of team draft on two short rankings."""
    rows = [(i, d, t, p) for i, (docs, teams, p) in enumerate(ex.team_draft_outcomes([1, 2, 3, 4], [2, 5, 1, 6], 4)) for d, t in zip(docs, teams, strict=True)]
    return spark.createDataFrame(rows, "outcome long, doc_id long, team string, probability double")


@query
def click_sim_pbm(spark, sf):
    """Click rate by rank and grade over one simulated page a session and topic rank."""
    p = ui_events(spark, sf).select(F.col("event_id").alias("page"), "rank", (F.col("doc_id") % 4).cast("int").alias("grade"))
    return ex.simulate_clicks(p).groupBy("rank", "grade").agg(F.count("*").alias("n"), F.sum(F.col("clicked").cast("long")).alias("clicks"))


# Learning

def _queries_words(spark, sf):
    return topics(spark, sf).select("qid", F.size(simple_tokens(F.col("text"))).alias("n_words"))


@query
def ltr_features(spark, sf):
    run = lexical_run(spark, sf, 20)
    return le.features(run, lexical_run(spark, sf), dense_run(spark, sf), _queries_words(spark, sf), index(spark, sf).docs)


def _clicks(spark, sf):
    e = ui_events(spark, sf).filter("type = 'click'")
    return e.groupBy(F.lit("all").alias("qid"), "doc_id", "rank").agg(F.count("*").alias("clicks"))


@query
def ips_weights(spark, sf):
    eta = spark.range(1, 11).select(F.col("id").alias("rank"), (1.0 / F.col("id")).alias("eta"))
    return le.ips_weights(_clicks(spark, sf), eta, clip=5.0)


def _swaps(spark, sf):
    e = ui_events(spark, sf).filter("type IN ('impression', 'click')")
    return e.select("rank", (F.col("event_id") % 2).alias("swapped"), (F.col("type") == "click").cast("double").alias("clicked"))


@query
def propensity_swap(spark, sf):
    return le.swap_propensity(_swaps(spark, sf))


@query
def propensity_filled(spark, sf):
    return le.filled(le.swap_propensity(_swaps(spark, sf)).filter("rank <> 4"))


@query
def hard_negatives(spark, sf):
    return le.hard_negatives(lexical_run(spark, sf), dense_run(spark, sf), judgements(spark, sf))


@query
def harvest_ratios(spark, sf):
    """Examination ratios of two made-up rankers that show each clicked document at ranks k % 10 + 1 and k % 7 + 1."""
    e = ui_events(spark, sf).filter("type IN ('impression', 'click')").withColumn("logger", F.pmod("event_id", F.lit(2)))
    shown = e.withColumn("rank", F.when(F.col("logger") == 0, F.col("doc_id") % 10 + 1).otherwise(F.col("doc_id") % 7 + 1))
    per = shown.groupBy("logger", F.lit("all").alias("qid"), "doc_id", "rank").agg(F.sum((F.col("type") == "click").cast("int")).alias("clicks"), F.count("*").alias("sessions"))
    return le.harvest_ratios(per)


@query
def training_groups(spark, sf):
    mined = le.hard_negatives(lexical_run(spark, sf), dense_run(spark, sf), judgements(spark, sf)).unionByName(
        judgements(spark, sf).select("qid", "doc_id", F.lit("positive").alias("source")))
    return le.training_groups(mined)


def _graded(spark, sf):
    """The lexical run's top 10 as rankings numbered from 0, graded by the judgements."""
    run = lexical_run(spark, sf, 10).join(judgements(spark, sf), ["qid", "doc_id"], "left").fillna(0, ["grade"])
    return run.select("qid", "doc_id", "rank", "grade")


@query
def swap_simulation(spark, sf):
    """Examination by rank, estimated from simulated swap interventions."""
    return le.swap_propensity(si.swap_rates(si.swap_logs(spark, 20_000, _graded(spark, sf), share=0.5)))


@query
def noisy_rankers(spark, sf):
    j = judgements(spark, sf)
    return ev.ndcg(si.noisy_oracle(j, 0.5), j)


# Serving logs

def _requests(spark, sf):
    """A request for each event: costs and states from its value and k."""
    e, k, v = table(spark, sf, "events"), F.get_json_object("props", "$.k").cast("int"), F.coalesce("value", F.lit(0.0))
    return e.select(
        "event_id", (k % 2 == 0).alias("dense"), (k % 3 > 0).alias("rerank"), (k % 5 > 0).alias("lexical"), (k % 11 > 0).alias("encoder_ok"), (k % 13 > 0).alias("vectors_ok"),
        (k % 17 > 0).alias("reranker_ok"), (v * 4).alias("remaining_ms"), sv.pressure_level(k, [50, 75, 95]).alias("pressure"), (k % 29 == 0).alias("probe"),
        F.lit(8.0).alias("encode_ms"), (v * 0.9).alias("shard_full_ms"), (v * 0.5).alias("shard_shrunk_ms"), (v * 0.3).alias("shard_lexical_ms"), (v * 3.0).alias("rerank_ms"), F.lit(2.0).alias("fetch_ms"))


@query
def degradation_plan(spark, sf):
    plan = sv.degradation_plan(_requests(spark, sf))
    return plan.groupBy("level", "use_dense", "shrink_beam", "use_rerank", "use_lexical").agg(F.count("*").alias("n"))


@query
def rolling_latency(spark, sf):
    return sv.rolling_latency(table(spark, sf, "events").filter("value IS NOT NULL").select("ts", F.col("value").alias("ms")))


@query
def dwell_times(spark, sf):
    return sv.dwell(ui_events(spark, sf))


@query
def abandoned_pages(spark, sf):
    return sv.abandoned(pages(spark, sf))


@query
def availability(spark, sf):
    e, k = table(spark, sf, "events"), F.get_json_object("props", "$.k").cast("int")
    return sv.availability(e.select(F.col("event_type").alias("phase"), F.when(k % 10 == 0, 503).otherwise(200).alias("status"), (k % 4 - 2).alias("degradation"),
                                    F.coalesce("value", F.lit(0.0)).alias("latency_ms"), F.when(k % 3 > 0, k % 10 + 1).alias("first_relevant")))


@query
def score_agreement(spark, sf):
    return sv.score_agreement(bm25_topk(spark, sf), bm25_idf_only(spark, sf).withColumn("score", F.col("score") * 1.9))


@query
def document_shards(spark, sf):
    return corpus(spark, sf).groupBy(sv.shard_of(F.col("doc_id"), 4).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query
def degradation_notice(spark, sf):
    plan = sv.notices(sv.degradation_plan(_requests(spark, sf)))
    return plan.groupBy("level", "notice").agg(F.count("*").alias("n"))


@query
def dense_for_candidates(spark, sf):
    """The lexical candidates that have a vector, reordered by it."""
    asked = vectors(spark, sf).join(topics(spark, sf).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi")
    return le.dense_for(lexical_run(spark, sf), asked.select(F.col("vec_id").alias("qid"), "embedding"), vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")).select(
        "qid", "doc_id", "rank", "score")


@query
def list_ndcg(spark, sf):
    """nDCG@10 of the lists ordered by their token share."""
    return le.ranked_lists(rerank_scores(spark, sf).select("qid", "doc_id", F.col("rerank").alias("score")), judgements(spark, sf))


# Streams: memory sinks over all available files, equal to their batch twins

def _stream(spark, sf):
    # A pattern, as a file source takes folders and patterns only; the table may be one file or a folder of them.
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")


def _drive(spark, df, name, mode):
    return live.run_to_end(df, name, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}", mode)


@query
def stream_hourly(spark, sf):
    return _drive(spark, live.hourly_counts(_stream(spark, sf).select("ts", "event_type")), "stream_hourly", "complete")


@query
def stream_slo_burn(spark, sf):
    return _drive(spark, live.sliding_rates(_stream(spark, sf).select("ts", "event_type")), "stream_slo_burn", "complete")


@query
def stream_first_seen(spark, sf):
    """Counts of events whose every row comes twice, without the repeats."""
    e = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = e.select("event_id", "ts", "event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    seen = _drive(spark, live.first_seen(twice, "event_id").select("event_id", "event_type"), "stream_first_seen", "append")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"))


@query
def click_within_hour(spark, sf):
    e = table(spark, sf, "events")
    return live.click_join(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), None)


@query
def stream_click_join(spark, sf):
    e = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    return _drive(spark, live.click_join(e.filter("event_type = 'view'"), e.filter("event_type = 'click'")), "stream_click_join", "append")


# Relational substrate

@query
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
                                                           F.count("*").alias("n"))


@query
def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query
def nation_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query
def top_orders_per_customer(spark, sf):
    order = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")
