import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import english, text
from quern.operators import lucene as lu
from quern.sources import formats as fm


def terms(s):
    return [t for t, _, _ in english.analyse(s)]


def test_analysis_chain():
    assert terms("John's JOHN'S the dogs'S") == ["john", "john", "dog"]
    assert terms("caresses ponies caress cats feed agreed relational vietnamization electriciti formaliti") == ["caress", "poni", "caress", "cat", "feed", "agre", "relat", "vietnam", "electr", "formal"]
    assert terms("U.S.A e.g. 3.14 a.b 1,000 user_name") == ["u.s.a", "e.g", "3.14", "a.b", "1,000", "user_nam"]
    assert terms("İstanbul ΣΊΣΥΦΟΣ café") == ["istanbul", "σίσυφοσ", "café"]
    assert terms("東京タワー 한국어 👍🏽🇺🇸") == ["東", "京", "タワー", "한국어", "👍🏽", "🇺🇸"]
    assert [len(w) for w, _, _ in english.tokens("x" * 600)] == [255, 255, 90]
    assert terms("") == terms("the of and") == [] and english.analyse(None) == []


def test_length_byte_round_trip():
    assert all(lu.length_byte(lu.byte_length(b)) == b for b in range(256))
    assert [lu.byte_length(lu.length_byte(n)) for n in range(24)] == list(range(24))
    decoded = [lu.byte_length(lu.length_byte(n)) for n in range(5000)]
    assert decoded == sorted(decoded) and all(d <= n for n, d in enumerate(decoded))


def test_exact_scores_order_like_the_formula(spark):
    docs = spark.createDataFrame([(1, "cats and dogs"), (2, "cat cat bird"), (3, "birds"), (4, "the"), (5, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cats birds"), (2, "the")], "qid long, text string")
    got = [(r.qid, r.doc_id) for r in lu.bm25_exact(docs, queries).orderBy("qid", "rank").collect()]
    assert got[0] == (1, 2) and {d for _, d in got} == {1, 2, 3}
    assert all(np.float32(r.score) == r.score for r in lu.bm25_exact(docs, queries).collect())


def test_snippet_keeps_limits():
    body = "Nothing here. The quick brown fox jumps over a lazy dog; the quick cat sleeps élan élan."
    s, marks = english.snippet(body, {"quick", "cat"}, 40)
    assert len(s.encode()) <= 40 and {s[a:b] for a, b in marks} == {"quick", "cat"} and s in body
    assert english.snippet("", {"x"}) == ("", [])


def test_spans(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 3, 4), (2, 1, 1)], "id long, start long, end long")
    assert sorted(tuple(r) for r in lu.merge_spans(spans).select("id", "start", "end").collect()) == [(1, 0, 7), (1, 9, 10)]


def test_deletes_and_normal_forms(spark):
    row = spark.createDataFrame([("abc", "  Ab \t C ")], "w string, q string").select(
        text.deletes(F.col("w")).alias("d"), text.normalise_query(F.col("q")).alias("n"), text.normalise_prefix(F.col("q")).alias("p"), text.valid_id(F.lit("a-b_1")).alias("v")).first()
    assert sorted(row.d) == ["a", "ab", "abc", "ac", "b", "bc", "c"] and row.n == "ab c" and row.p == "ab c " and row.v


def test_formats_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(3, "a\tb\nc"), (1, "x")], "doc_id long, text string")
    fm.write_tsv(docs, f"{tmp_path}/c", "doc_id")
    assert {(r.doc_id, r.text) for r in fm.read_collection(spark, f"{tmp_path}/c").collect()} == {(3, "a b c"), (1, "x")}
    (tmp_path / "bad").write_text("one\ttext\n")
    with pytest.raises(Exception, match="not a collection line"):
        fm.read_collection(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "q").write_text("7\ta\tb\n")
    assert fm.read_queries(spark, f"{tmp_path}/q").first().text == "a\tb"
    qrels = spark.createDataFrame([("1", "5", 2), ("1", "10", 1)], "qid string, doc_id string, grade int")
    fm.write_qrels(qrels, f"{tmp_path}/j")
    assert {tuple(r) for r in fm.read_qrels(spark, f"{tmp_path}/j").collect()} == {("1", "5", 2), ("1", "10", 1)}
    run = spark.createDataFrame([("1", "b", 1, 0.5), ("1", "9", 2, 0.5), ("1", "10", 3, 0.5)], "qid string, doc_id string, rank int, score double")
    fm.write_run(run, f"{tmp_path}/r")
    back = fm.read_run(spark, f"{tmp_path}/r")
    assert [r.doc_id for r in fm.ranked(back).orderBy("rank").collect()] == ["9", "10", "b"]
    assert [r.doc_id for r in fm.ranked(back, "file").orderBy("rank").collect()] == ["b", "9", "10"]
    fm.write_run(run, f"{tmp_path}/e", exact=True)
    assert [r.doc_id for r in fm.ranked(fm.read_run(spark, f"{tmp_path}/e")).orderBy("rank").collect()] == ["b", "9", "10"]
    assert [round(r.score, 6) for r in fm.tie_adjusted(run).orderBy("rank").collect()] == [0.5, 0.499999, 0.499998]


def test_matrix_json_and_events(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(3, 2)
    (tmp_path / "m.fbin").write_bytes(np.array([3, 2], "<u4").tobytes() + x.tobytes())
    assert [list(r.embedding) for r in fm.read_matrix(spark, f"{tmp_path}/m.fbin").orderBy("row").collect()] == x.tolist()
    (tmp_path / "p.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n{"_id": "2", "title": "", "text": "y"}\n')
    assert {r.text for r in fm.read_passages_json(spark, f"{tmp_path}/p.jsonl").collect()} == {"T x", "y"}
    (tmp_path / "log").write_text('{"type": "click", "doc_id": 4, "rank": 1}\nnot json\n{"events": [{"type": "query", "query": "a"}, {"type": "click", "doc_id": 5}]}\n{"kind": "served", "results": [{"doc_id": 1, "rank": 1, "team": "A"}]}\n')
    events = fm.read_events(spark, f"{tmp_path}/log")
    assert sorted(str(r.type) for r in events.collect()) == ["None", "click", "click", "query"]
    fm.write_events(events.withColumn("server_ts", F.lit("2026-01-02 03:04:05").cast("timestamp")), f"{tmp_path}/out")
    assert (tmp_path / "out" / "hour=20260102-03").exists()
    (tmp_path / "x.json").write_text('{"experiments": [{"id": "a", "allocation": 0.5} /* half */]}')
    assert fm.read_experiments(spark, f"{tmp_path}/x.json")[0]["id"] == "a"
