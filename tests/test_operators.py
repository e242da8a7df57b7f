import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation as ev
from quern.operators import experiments as ex
from quern.operators import fusion as fu
from quern.operators import learning as le
from quern.operators import lexical as lx
from quern.operators import suggest as su
from quern.operators import vector as ve


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocab, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 30))) for _ in range(120)]
    texts += ["", None, "!!!", texts[0], texts[0]]
    return spark.createDataFrame([(3 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").cache()


def brute_bm25(docs, terms, k1=0.9, b=0.4, factor=1.9):
    held = {d: t.split() for d, t in docs if t and t != "!!!"}
    avg = sum(map(len, held.values())) / len(held)
    out = {}
    for term, boost in Counter(terms).items():
        df = sum(term in t for t in held.values())
        for d, t in held.items():
            tf = t.count(term)
            if tf:
                w = boost * math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * factor
                out[d] = out.get(d, 0) + w - w / (1 + tf / (k1 * (1 - b + b * len(t) / avg)))
    return sorted(((round(-s, 6), d) for d, s in out.items()))


@pytest.mark.parametrize("k", [0, 1, 10, 1000])
def test_bm25_equals_brute_force_and_pruning_changes_nothing(spark, corpus, k):
    rng = random.Random(k)
    queries = [(q, " ".join(rng.choices([f"w{i}" for i in range(40)] + ["oov"], k=rng.randint(1, 6)))) for q in range(6)] + [(99, "oov"), (98, "")]
    q = spark.createDataFrame(queries, "qid long, text string")
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    expected = sorted((qid, d, i, -s) for qid, text in queries for i, (s, d) in enumerate(brute_bm25(docs, text.split())[:k], 1))
    got = rows(lx.bm25(corpus, q, k), "qid", "doc_id", "rank", "score")
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], atol=2e-6)
    assert rows(lx.pruned(corpus, q, k), "qid", "doc_id", "rank", "score") == got


def test_explain_sums_to_the_score(spark, corpus):
    q = spark.createDataFrame([(1, "w1 w3 w3 w20")], "qid long, text string")
    total = lx.explain(corpus, q, 5).groupBy("doc_id").agg(F.sum("score").alias("s"), F.sum("share").alias("one"))
    best = {r.doc_id: r.score for r in lx.bm25(corpus, q, 5).collect()}
    for r in total.collect():
        assert abs(r.s - best[r.doc_id]) < 1e-3 and abs(r.one - 1) < 1e-2


def test_empty_collection(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "qid long, text string")
    assert lx.bm25(none, q).count() == 0 and lx.postings(none).count() == 0


def test_fusion_limits_and_constant_lists(spark):
    lexical = spark.createDataFrame([(1, 10, 1, 3.0), (1, 11, 2, 1.0), (2, 20, 1, 5.0)], "qid long, doc_id long, rank long, score double")
    dense = spark.createDataFrame([(1, 11, 1, 0.9), (1, 12, 2, 0.1)], "qid long, doc_id long, rank long, score double")
    assert [r[2] for r in rows(fu.normalise(lexical, "minmax"), "qid", "doc_id", "norm")] == [1.0, 0.0, 1.0]
    assert rows(fu.normalise(lexical, "zscore"), "qid", "doc_id", "norm")[2] == (2, 20, 0.0)
    assert [r[1] for r in sorted(rows(fu.fuse(lexical, dense, alpha=1.0, norm="minmax"), "rank", "doc_id", "qid")) if r[2] == 1][0] == 11
    assert rows(fu.weighted(lexical, dense, 0.5, "minmax"), "qid", "doc_id", "score") == [(1, 10, 0.5), (1, 11, 0.5), (1, 12, 0.0), (2, 20, 0.5)]
    rrf = dict((r[1], r[2]) for r in rows(fu.reciprocal_rank([lexical, dense]), "qid", "doc_id", "score"))
    assert rrf[11] == round(1 / 61 + 1 / 62, 6)
    with pytest.raises(ValueError):
        fu.weighted(lexical, dense, 1.5)


def test_cascade_moves_the_head_only(spark):
    run = spark.createDataFrame([(1, d, d, 1.0 / d) for d in range(1, 6)], "qid long, doc_id long, rank long, score double")
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 3, 0.9), (1, 5, 9.0)], "qid long, doc_id long, rerank double")
    assert [d for _, d in rows(fu.cascade(run, scores, 3), "new_rank", "doc_id")] == [3, 1, 2, 4, 5]


def test_metrics_by_hand(spark):
    run = ev.evaluator_order(spark.createDataFrame([(1, 9, 1.0), (1, 10, 1.0), (1, 3, 0.5), (2, 1, 1.0)], "qid long, doc_id long, score double"))
    qrels = spark.createDataFrame([(1, 3, 2), (1, 10, 1), (3, 1, 1), (4, 1, 0)], "qid long, doc_id long, grade int")
    assert rows(run.filter("qid = 1"), "rank", "doc_id") == [(1, 9), (2, 10), (3, 3)]  # ties by id as text, descending
    assert rows(ev.reciprocal_rank(run, qrels), "qid", "value") == [(1, 0.5), (3, 0.0), (4, 0.0)]
    ideal = 2 + 1 / math.log2(3)
    assert rows(ev.ndcg(run, qrels), "qid", "value")[0] == (1, round((1 / math.log2(3) + 2 / 2) / ideal, 6))
    assert rows(ev.recall(run, qrels, 2), "qid", "value") == [(1, 0.5), (3, 0.0), (4, 0.0)]
    assert ev.parse_metric("R(rel=2)@1000") == ("R", 2, 1000)
    assert {r.metric for r in ev.evaluate(run.drop("rank"), qrels, ["RR@10", "nDCG@10"]).collect()} == {"RR@10", "nDCG@10"}


def test_holm_and_tests(spark):
    family = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    assert rows(ev.holm(family), "name", "p_holm") == [("a", 0.04), ("b", 0.09), ("c", 0.09), ("d", 0.5)]
    assert ev.sign_test(0, 0) == 1.0 and abs(ev.sign_test(9, 1) - 22 / 1024) < 1e-12
    assert np.allclose(ev.isotonic([1, 3, 2, 4], [1, 1, 1, 1]), [1, 2.5, 2.5, 4])
    values = spark.createDataFrame([("x", i, 0.0, float(i % 7 > 1)) for i in range(60)], "name string, qid long, a double, b double")
    r = ev.paired_tests(values).first()
    assert r.p < 0.01 and r.lo < r.delta < r.hi


def test_team_draft_rules():
    coins = iter([True, True])
    assert ex.team_draft([1, 2, 3, 4], [5, 6, 7, 8], 4, lambda: next(coins)) == ([1, 5, 2, 6], ["A", "B", "A", "B"], 2)
    coins = iter([False, True, True])
    assert ex.team_draft([1, 2, 3, 4, 5], [2, 1, 6, 3, 7], 5, lambda: next(coins)) == ([2, 1, 3, 6, 4], ["B", "A", "A", "B", "A"], 3)
    assert ex.team_draft([1, 2, 3, 4, 5, 6], [1], 5, lambda: True) == ([1, 2, 3, 4, 5], ["A"] * 5, 1)
    assert ex.team_draft([1, 2], [2, 3], 10, lambda: True) == ([1, 2, 3], ["A", "B", "B"], 2)
    assert ex.team_draft([], [], 5, lambda: True) == ([], [], 0)
    outcomes = ex.team_draft_outcomes([1, 2, 3, 4], [2, 5, 1, 6], 4)
    assert sorted(x[0] for x in outcomes) == [[1, 2, 3, 5], [1, 2, 5, 3], [2, 1, 3, 5], [2, 1, 5, 3]] and all(p == 0.25 for *_, p in outcomes)
    assert ex.team_draft_credit({1: "A", 5: "B"}, [1, 1, 9]) == (1, 0, "A")


def test_assignment_vectors(spark):
    # Buckets and arms that other implementations produce.
    for salt, session, share, bucket, arm in [("2026-09-23-a", "b2c4f1", 0.2, 9691, None), ("2026-09-23-a", "", 1.0, 7469, "treatment"), ("x", "session-42", 0.5, 5048, None),
                                              ("s", "ümlaut-€", 1.0, 9819, "control"), ("2026-09-24", "abc", 0.9999, 4120, "treatment")]:
        assert ex.bucket(salt, session) == bucket
        assert (ex.arm(salt, session) if bucket < round(share * 10_000) else None) == arm
    got = rows(ex.assign(spark.createDataFrame([("abc",), (None,)], "session_id string"), [{"id": "e", "salt": "2026-09-24", "allocation": 0.9999}]).fillna("-"), "session_id", "variant")
    assert ("abc", "treatment") in got


def test_interleaving_relatives():
    assert ex.balanced([1, 2, 3], [3, 1, 4], 4, True) == [1, 3, 2, 4]
    assert ex.balanced_credit([1, 2, 3], [3, 1, 4], [1, 3, 2, 4], [1]) == (0, 1, "B")
    assert np.allclose(ex.probabilistic_credit(np.array([[1.0, 0.5]]), np.array([[True, True]])), [0.5])


def test_events_and_pages(spark):
    schema = "type string, session_id string, request_id string, query string, doc_id long, rank long, dwell_ms long, team string"
    events = spark.createDataFrame([
        ("impression", "s", "r", None, 1, 1, None, None), ("impression", "s", "r", None, 2, 2, None, "A"), ("click", "s", "r", None, 2, 2, None, None), ("click", "s", "r", None, 2, 2, None, None),
        ("click", "s", "r", None, 9, 9, None, None), ("click", "s", None, None, 1, 1, None, None), ("dwell", "s", "r", None, 1, 1, None, None), ("hover", "s", "r", None, 1, 1, None, None),
        ("query", "bad id!", None, None, None, None, None, None), ("query", "s", None, "x" * 513, None, None, None, None), ("click", "s", "r", None, 1, 0, None, None), (None, None, None, None, None, None, None, None),
    ], schema)
    errors = [r.error for r in ex.validate_events(events).collect()]
    assert errors == [None, None, None, None, None, "request_id required", "dwell_ms", "type", "session_id", "query", "rank", "type"]
    page = ex.pages_from_events(events.filter("rank > 0")).first()
    assert (page.shown, page.clicks, page["first"], page.clicked_at_1, page.unserved) == (2, 1, 2, 0, 1)


def test_spelling_and_completion(spark):
    assert su.osa("ca", "abc", 3) == 3 and su.osa("teh", "the", 2) == 1 and su.osa("abcdef", "a", 2) == 3
    counts = spark.createDataFrame([("the", 10), ("they", 5), ("then", 5), ("cat", 3), ("rare", 1)], "query string, n long")
    best = [r["query"] for r in su.completions(counts, 2).filter("prefix = 'the'").orderBy("rank").collect()]
    assert best == ["the", "then"]
    fixed = rows(su.correct(spark.createDataFrame([("teh",), ("cat",), ("zzzzzz",), ("rare",)], "word string"), counts.withColumnRenamed("query", "word")), "word", "candidate")
    assert ("teh", "the") in fixed and not any(w in ("cat", "zzzzzz") for w, _ in fixed)


def test_vector_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    asked = v.filter("vec_id % 100 = 0")
    truth = ve.knn_blocks(v, asked, 10)
    for q in (0, 100, 200):
        want = np.lexsort((np.arange(300), -np.round(x.astype(float) @ x[q].astype(float), 6)))[:10].tolist()
        assert [r.vec_id for r in truth.filter(F.col("qid") == q).orderBy("rank").collect()] == want
    for found in (ve.in_blocks(asked, lambda b: ve.graph_search(v, b, 10)), ve.in_blocks(asked, lambda b: ve.ivf_pq(v, b, 10, probes=16))):
        assert ve.recall_at_k(found, truth).agg(F.avg("recall")).first()[0] >= 0.9
    blocks = list(ve.query_blocks(v, size=128))
    assert [len(b) for b in blocks] == [128, 128, 44]


def test_inverse_propensity_is_naive_at_eta_one(spark):
    clicks = spark.createDataFrame([("q", 1, 1, 4), ("q", 2, 2, 3)], "qid string, doc_id long, rank long, clicks long")
    flat = spark.createDataFrame([(1, 1.0), (2, 1.0)], "rank long, eta double")
    assert all(r.naive == r.weight for r in le.ips_weights(clicks, flat).collect())
    eta = spark.createDataFrame([(1, 1.0), (2, None), (3, 0.0), (4, 0.25)], "rank long, eta double")
    assert [r.eta for r in le.filled(eta).orderBy("rank").collect()] == [1.0, 1.0, 1.0, 0.25]


def test_clicks_follow_position(spark):
    pages = spark.range(4000).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("grade", F.lit(3))
    rate = {r["rank"]: r.c for r in ex.simulate_clicks(pages).groupBy("rank").agg(F.avg(F.col("clicked").cast("int")).alias("c")).collect()}
    for k in range(1, 6):
        assert abs(rate[k] - 0.9 / k) < 0.03
    stops = {r["rank"]: r.c for r in ex.simulate_clicks(pages, "navigational", "dbn").groupBy("rank").agg(F.avg(F.col("clicked").cast("int")).alias("c")).collect()}
    assert stops[1] > 0.9 and stops[2] < 0.2


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    json.dumps(entry.oracle_sql())
