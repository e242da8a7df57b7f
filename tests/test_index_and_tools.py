"""The stored index against exhaustive search, completion and mode operators, and interchange tools."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.text import instructed, ulid, utf16_offset
from quern.operators import evaluation as ev
from quern.operators import experiments as ex
from quern.operators import fusion as fu
from quern.operators import lexical as lx
from quern.operators import serving as sv
from quern.operators import suggest as su
from quern.operators import vector as ve
from quern.sources import formats as fm


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pruned_search_of_a_stored_index_equals_exhaustive_search(spark):
    rng = random.Random(3)
    corpus = fm.zipf_corpus(spark, 900, vocabulary=300, longest=40, seed=5)
    asked = [(q, " ".join(f"w{rng.choice((1, 2, 3, 7, 40, 150, 299, 10**6))}" for _ in range(rng.randint(1, 9)))) for q in range(12)] + [(50, ""), (51, "nowhere")]
    topics = spark.createDataFrame(asked, "qid long, text string")
    lx.store_index(corpus, "quern_test_index", 3)
    index = lx.read_index(spark, "quern_test_index")
    for k, k1, b, model in ((1, 0.9, 0.4, "textbook"), (10, 1.2, 0.75, "lucene"), (50, 2.0, 0.1, "textbook")):
        want = rows(lx.bm25(corpus, topics, k, k1, b, model), "qid", "rank", "doc_id", "score")
        assert rows(lx.bm25(index, topics, k, k1, b, model), "qid", "rank", "doc_id", "score") == want
        assert rows(lx.pruned(index, topics, k, k1, b, model), "qid", "rank", "doc_id", "score") == want
    report = lx.pruning_report(index, topics, 1).collect()
    assert all(r.postings_kept <= r.postings and r.blocks_kept <= r.blocks for r in report) and sum(r.postings_kept for r in report) < sum(r.postings for r in report)
    some = spark.createDataFrame([(0, 1), (0, 10**9), (51, 4)], "qid long, doc_id long")
    exact = {(r.qid, r.doc_id): r.score for r in lx.bm25(corpus, topics, 900).collect()}
    assert rows(lx.selected(index, topics, some), "qid", "doc_id", "score") == sorted((q, d, exact.get((q, d), 0.0)) for q, d in ((0, 1), (0, 10**9), (51, 4)))


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    topics = spark.createDataFrame([(1, "a b")], "qid long, text string")
    assert lx.bm25(empty, topics).count() == 0 and lx.pruned(empty, topics).count() == 0


def test_modes_and_scorer(spark):
    lex = spark.createDataFrame([(q, d, d + 1, 9.0 - d) for q in (1, 2, 3) for d in range(3)], "qid long, doc_id long, rank int, score double")
    dense = spark.createDataFrame([(1, 7, 1, 0.5), (3, 8, 1, 0.4)], "qid long, doc_id long, rank int, score double")
    modes = spark.createDataFrame([(1, "dense"), (2, "dense"), (3, "hybrid")], "qid long, mode string")
    got = rows(fu.by_mode(modes, lex, dense, 2), "qid", "mode", "doc_id")
    assert got[:3] == [(1, "dense", 7), (2, "lexical", 0), (2, "lexical", 1)] and {m for q, m, _ in got if q == 3} == {"hybrid"}
    pairs = spark.createDataFrame([(1, d, "q", "x" * d) for d in range(5)], "qid long, doc_id long, query string, text string")
    two = lambda: lambda q, t: [[1.0, 1.0 + len(x)] for x in t]
    assert rows(fu.score_pairs(pairs, two, batch=2), "doc_id", "rerank") == [(d, float(d)) for d in range(5)]


def test_suggestions(spark):
    counts = spark.createDataFrame([("car", 3), ("cart", 5), ("dog", 1)], "query string, n long")
    asked = spark.createDataFrame([("ca",), ("",), ("zz",)], "prefix string")
    assert rows(su.lookup(counts, asked, 2), "prefix", "rank", "query") == [("", 1, "cart"), ("", 2, "car"), ("ca", 1, "cart"), ("ca", 2, "car")]
    words = spark.createDataFrame([(1, 0, "dgo"), (1, 1, "car"), (2, 0, "car")], "qid long, pos int, word string")
    fixed = su.suggest_queries(words, spark.createDataFrame([("dgo", "dog")], "word string, candidate string"))
    assert rows(fixed.fillna("-"), "qid", "suggestion") == [(1, "dog car"), (2, "-")]
    queries = spark.createDataFrame([(1, "dgo car")], "qid long, query string")
    assert su.did_you_mean(fixed, queries, spark.createDataFrame([("dgo car",)], "query string")).count() == 0
    assert su.did_you_mean(fixed, queries, spark.createDataFrame([("dog",)], "query string")).count() == 1


def test_alignment_is_strict(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "qid long, value double")
    assert rows(ev.aligned(a, a), "qid", "a", "b") == [(1, 0.5, 0.5), (2, 0.25, 0.25)]
    with pytest.raises(Exception, match="query ids differ"):
        ev.aligned(a, a.filter("qid = 1")).collect()
    boot = ev.bootstrap_means(spark.createDataFrame([("x", float(i % 4)) for i in range(400)], "name string, value double")).first()
    assert boot.n == 400 and boot.mean == 1.5 and 1.3 < boot.lo < 1.5 < boot.hi < 1.7


def test_interchange(spark, tmp_path):
    found = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.25)], "qid long, rank int, vec_id long, score double")
    fm.write_ground_truth(found, f"{tmp_path}/gt")
    ids = spark.createDataFrame([(5, 50), (6, 60)], "vec_id long, pid long")
    assert rows(fm.read_ground_truth(spark, f"{tmp_path}/gt", ids), "rank", "pid") == [(1, 50), (2, 60)]
    mined = spark.createDataFrame([(1, 5, "dense"), (1, 4, "lexical"), (2, 9, "dense")], "qid long, doc_id long, source string")
    fm.write_mined(mined, f"{tmp_path}/mined")
    assert rows(fm.read_mined(spark, f"{tmp_path}/mined"), "qid", "doc_id", "source") == [(1, 4, "lexical"), (1, 5, "dense"), (2, 9, "dense")]
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.txt").write_bytes(b"abc")
    manifest = spark.createDataFrame([("a.txt", hashlib.md5(b"abc").hexdigest()), ("b.txt", "0")], "name string, md5 string")
    assert rows(fm.checked_manifest(spark, f"{tmp_path}/files", manifest), "name", "ok") == [("a.txt", True), ("b.txt", False)]
    assert fm.judged_topics(ids.select(F.col("pid").alias("qid")), spark.createDataFrame([(50,)], "qid long")).count() == 1


def test_columns(spark):
    one = spark.createDataFrame([("é𝐀x",)], "t string").select(*[utf16_offset(F.col("t"), F.lit(b)).cast("int").alias(f"b{b}") for b in (0, 2, 6, 7)]).first()
    assert list(one) == [0, 1, 3, 4]
    ids = [r[0] for r in spark.sql("SELECT timestamp_millis(id * 7) AS ts, id FROM range(50)").select(ulid(F.col("ts"), "id")).collect()]
    assert all(len(x) == 26 for x in ids) and sorted(x[:10] for x in ids) == [x[:10] for x in ids] and len(set(ids)) == 50
    assert spark.createDataFrame([(" a  b c ",)], "t string").select(instructed(F.col("t"), "q: ", 2)).first()[0] == "q: a b"
    plan = spark.createDataFrame([(0,), (3,)], "level int")
    assert [r.notice for r in sv.notices(plan).orderBy("level").collect()] == ["", "Results are matched by words only."]
    asked = spark.createDataFrame([(None, None, None), ("x", None, None), ("x", 101, None), ("x", 1, "other")], "q string, k int, mode string")
    assert [r.error for r in sv.validate_requests(asked).collect()] == ["q", None, "k", "mode"]
    assert sv.without(spark.createDataFrame([(1, 2)], "a int, ms_b int"), "ms_").columns == ["a"]
    teams = spark.createDataFrame([(f"r{i}", 1, "A" if i % 4 else "B") for i in range(16)], "request_id string, rank int, team string")
    assert tuple(ex.team_balance(teams).first()) == (12, 4, 2.0)


def test_quantiser_keeps_dimensions_that_do_not_divide_evenly():
    x = np.random.default_rng(1).normal(size=(400, 10)).astype(np.float32)
    pq = ve.ProductQuantiser(x, parts=4, size=16)
    codes = pq.encode(x)
    assert pq.decode(codes).shape == x.shape and [c.stop - c.start for c in pq.cuts] == [2, 3, 2, 3]
    assert np.allclose(pq.inner_products(x[0], codes), pq.decode(codes) @ x[0], atol=1e-4)
