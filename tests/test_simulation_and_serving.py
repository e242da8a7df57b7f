import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import learning as le
from quern.operators import serving as sv
from quern.operators import simulation as si
from quern.operators import vector as ve
from quern.streaming import live


@pytest.fixture(scope="module")
def ranking(spark):
    return spark.createDataFrame([(q, 100 * q + r, r, (q + r) % 4) for q in range(8) for r in range(1, 11)], "qid long, doc_id long, rank int, grade int")


def test_swaps_recover_the_position_bias(spark, ranking):
    logs = si.swap_logs(spark, 60_000, ranking, share=1.0, profile="informational").cache()
    assert logs.groupBy("page").agg(F.countDistinct("rank").alias("n"), F.countDistinct("doc_id").alias("d")).filter("n <> 10 OR d <> 10").count() == 0
    eta = {r["rank"]: r.eta for r in le.swap_propensity(si.swap_rates(logs)).collect()}
    for k in range(2, 8):
        assert abs(eta[k] - 1 / k) < 0.06


def test_same_traffic_twice_and_even_queries(spark, ranking):
    one, two = (si.traffic(spark, 4000, ranking).repartition(n).agg(F.sum(F.col("clicked").cast("int")), F.count("*")).first() for n in (2, 7))
    assert one == two and one[1] == 40_000
    noise = spark.range(20_000).select(si.gaussian("id").alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(noise[0]) < 0.03 and abs(noise[1] - 1) < 0.03


def test_harvesting_recovers_the_bias(spark):
    eta = [1.0, 0.5, 0.25]
    rows = [(logger, "q", d, r, int(1000 * eta[r - 1] * rel), 1000) for logger, order in enumerate(((1, 2, 3), (2, 3, 1), (3, 1, 2))) for r, d in enumerate(order, 1) for rel in [0.2 * d]]
    shown = spark.createDataFrame(rows, "logger int, qid string, doc_id long, rank int, clicks long, sessions long")
    assert np.allclose(le.harvest_fit(le.harvest_ratios(shown), 4)[:3], eta, atol=0.02)
    assert np.isnan(le.harvest_fit(le.harvest_ratios(shown), 4)[3])


def test_planning_statistics():
    assert abs(si.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(si.chi_square_tail(5.991465, 2) - 0.05) < 1e-6
    assert abs(si.size_for_power(0.1, 2.0) - 2 * (1.959964 + 0.841621) ** 2 * 2 / 0.01) < 0.1
    assert si.n_at_power(np.array([10, 100, 1000]), np.array([0.1, 0.6, 1.0])) == pytest.approx(10**2.5) and si.n_at_power(np.array([10]), np.array([0.1])) is None
    assert si.welch(0, 1, 100, 0, 1, 100) == 1.0 and si.welch(0, 1, 100, 1, 1, 100) < 1e-6


def test_degradation_levels(spark):
    base = {"dense": True, "rerank": True, "lexical": True, "encoder_ok": True, "vectors_ok": True, "reranker_ok": True, "pressure": 0, "probe": False, "encode_ms": 10.0, "shard_full_ms": 50.0,
            "shard_shrunk_ms": 20.0, "shard_lexical_ms": 5.0, "rerank_ms": 100.0, "fetch_ms": 5.0}
    cases = [{"remaining_ms": x} | extra for x, extra in [(200.0, {}), (100.0, {}), (40.0, {}), (10.0, {}), (200.0, {"pressure": 2}), (1.0, {"probe": True}), (200.0, {"encoder_ok": False, "lexical": False})]]
    rows = spark.createDataFrame([base | c | {"i": i} for i, c in enumerate(cases)])
    got = [(r.level, r.use_dense, r.shrink_beam, r.use_rerank, r.use_lexical) for r in sv.degradation_plan(rows).orderBy("i").collect()]
    assert got == [(0, True, False, True, True), (1, True, False, False, True), (2, True, True, False, True), (3, False, False, False, True), (2, True, True, False, True), (0, True, False, True, True), (0, False, False, True, True)]


def test_matched_recall_and_traces(spark):
    points = spark.createDataFrame([("a", 0.8, 10.0), ("a", 1.0, 30.0), ("b", 0.7, 5.0)], "name string, recall double, cost double")
    assert [tuple(r) for r in sv.matched_recall(points, 0.9).collect()] == [("a", 20.0)]
    t = spark.createDataFrame([(f"00-{'a' * 32}-{'b' * 16}-01",), (f"00-{'0' * 32}-{'b' * 16}-01",), ("x",)], "h string").select(sv.traceparent(F.col("h")).alias("t")).collect()
    assert t[0].t.sampled and t[1].t is None and t[2].t is None


def test_graphs_are_navigable():
    x = np.random.default_rng(1).normal(size=(200, 8))
    graph, entry = ve.build_graph(x)
    assert ve.reachable(graph, entry) == 200 and max(map(len, graph)) <= 16
    again, _ = ve.build_graph(x)
    assert all((a == b).all() for a, b in zip(graph, again, strict=True))


def test_streams_equal_batches(spark, tmp_path):
    events = spark.range(500).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"),
                                     F.element_at(F.array(F.lit("view"), F.lit("click"), F.lit("error")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"))
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(live.run_to_end(live.hourly_counts(stream()), "t1", f"{tmp_path}/c1", "complete"), live.hourly_counts(events))
    split = lambda e: (e.filter("event_type = 'view'"), e.filter("event_type = 'click'"))
    assert same(live.run_to_end(live.click_join(*split(stream())), "t2", f"{tmp_path}/c2"), live.click_join(*split(events), None))
    live.append_log(stream(), f"{tmp_path}/log", f"{tmp_path}/c3").awaitTermination()
    assert spark.read.json(f"{tmp_path}/log").count() == 500
