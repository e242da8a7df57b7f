"""Ranking metrics, run comparison and significance."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evaluator_order(run: DataFrame) -> DataFrame:
    """Ranks as evaluators make them: score descending, document id as text descending."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), F.col("doc_id").cast("string").desc())
    return run.withColumn("rank", F.row_number().over(w))


def _judged(qrels: DataFrame) -> DataFrame:
    return qrels.select("qid").distinct()


def reciprocal_rank(run: DataFrame, qrels: DataFrame, k: int = 10, rel: int = 1) -> DataFrame:
    """qid and value for every judged query; a query without a hit is 0."""
    good = qrels.filter(F.col("grade") >= rel).select("qid", "doc_id")
    first = run.filter(F.col("rank") <= k).join(good, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("r"))
    return _judged(qrels).join(first, "qid", "left").select("qid", F.round(F.coalesce(1.0 / F.col("r"), F.lit(0.0)), 6).alias("value"))


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Linear gain over log2(rank + 1); the ideal takes all judged documents of the query."""
    gain = lambda r: F.col("grade") / F.log2(F.col(r) + 1)
    best = qrels.filter("grade > 0").withColumn("i", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "doc_id"))).filter(F.col("i") <= k)
    ideal = best.groupBy("qid").agg(F.sum(gain("i")).alias("ideal"))
    got = run.filter(F.col("rank") <= k).join(qrels.filter("grade > 0"), ["qid", "doc_id"]).groupBy("qid").agg(F.sum(gain("rank")).alias("dcg"))
    joined = _judged(qrels).join(ideal, "qid", "left").join(got, "qid", "left")
    return joined.select("qid", F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("value"))


def recall(run: DataFrame, qrels: DataFrame, k: int = 10, rel: int = 1) -> DataFrame:
    """Share of relevant documents in the top k; a query with none relevant is 0."""
    good = qrels.filter(F.col("grade") >= rel).select("qid", "doc_id")
    found = good.join(run.filter(F.col("rank") <= k).select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    per = found.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("v"))
    return _judged(qrels).join(per, "qid", "left").select("qid", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("value"))


def parse_metric(name: str) -> tuple[str, int, int]:
    """``RR@10``, ``nDCG@10``, ``R(rel=2)@1000`` as (kind, rel, k)."""
    m = re.fullmatch(r"(RR|nDCG|R)(?:\(rel=(\d+)\))?@(\d+)", name)
    if not m:
        raise ValueError(f"unknown metric {name!r}")
    return m[1], int(m[2] or 1), int(m[3])


def evaluate(run: DataFrame, qrels: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, qid, value of every metric, from one ranked run."""
    ranked = evaluator_order(run)
    out = None
    for name in metrics:
        kind, rel, k = parse_metric(name)
        one = ndcg(ranked, qrels, k) if kind == "nDCG" else (reciprocal_rank if kind == "RR" else recall)(ranked, qrels, k, rel)
        one = one.withColumn("metric", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Documents that two runs share in their top k, a share of k."""
    shared = a.filter(F.col("rank") <= k).join(b.filter(F.col("rank") <= k).select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("n"))
    both = a.select("qid").union(b.select("qid")).distinct()
    return both.join(shared, "qid", "left").select("qid", F.round(F.coalesce("n", F.lit(0)) / F.lit(float(k)), 6).alias("overlap"))


def parity(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Bucket of each query: identical lists, other order of the same documents (tie_order), other documents at the last score (tie_cutoff) or different."""
    one = lambda r, n: r.filter(F.col("rank") <= k).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias(n), F.min("score").alias(f"{n}_last"))
    j = one(a, "x").join(one(b, "y"), "qid", "full_outer")
    ids = lambda n: F.coalesce(F.col(f"{n}.doc_id"), F.array().cast("array<bigint>"))
    bucket = F.when(ids("x") == ids("y"), "identical").when(F.sort_array(ids("x")) == F.sort_array(ids("y")), "tie_order").when(
        F.col("x_last") == F.col("y_last"), "tie_cutoff").otherwise("different")
    return j.select("qid", bucket.alias("bucket"))


def holm(family: DataFrame) -> DataFrame:
    """``family`` (name, p) with Holm's step-down adjusted p: the running maximum of (m - i + 1) p, at most 1."""
    order = W.orderBy("p", "name")  # one family of comparisons, a handful of rows
    m = F.count("*").over(W.partitionBy())
    step = family.withColumn("i", F.row_number().over(order)).withColumn("scaled", F.least(F.lit(1.0), (m - F.col("i") + 1) * F.col("p")))
    return step.select("name", "p", F.round(F.max("scaled").over(order.rowsBetween(W.unboundedPreceding, 0)), 6).alias("p_holm"))


def _paired(group: pd.DataFrame, rounds: int, seed: int) -> tuple[float, float, float, float]:
    d = (group["b"] - group["a"]).to_numpy()
    rng = np.random.default_rng(seed)
    n, mean = len(d), float(d.mean())
    signs = rng.integers(0, 2, size=(rounds, n)) * 2 - 1
    p = (1 + int((np.abs((signs * d).mean(1)) >= abs(mean) - 1e-12).sum())) / (1 + rounds)
    boot = d[rng.integers(0, n, size=(rounds, n))].mean(1)
    return mean, p, float(np.quantile(boot, 0.025)), float(np.quantile(boot, 0.975))


def paired_tests(values: DataFrame, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """For each comparison of ``values`` (name, qid, a, b): mean difference, sign-flip randomisation p and percentile bootstrap interval."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("qid")
        mean, p, lo, hi = _paired(group, rounds, seed)
        return pd.DataFrame({"name": [group["name"].iloc[0]], "n": [len(group)], "delta": [round(mean, 6)], "p": [round(p, 6)], "lo": [round(lo, 6)], "hi": [round(hi, 6)]})

    return values.groupBy("name").applyInPandas(run, "name string, n long, delta double, p double, lo double, hi double")


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided sign test, ties dropped."""
    n = wins + losses
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(wins, losses) + 1)]
    return min(1.0, 2 * math.exp(max(logs)) * sum(math.exp(x - max(logs)) for x in logs))


def normal_tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def isotonic(y: np.ndarray, w: np.ndarray, increasing: bool = True) -> np.ndarray:
    """Weighted isotonic regression by pooling adjacent violators."""
    sign = 1.0 if increasing else -1.0
    blocks: list[list[float]] = []
    for value, weight in zip(sign * np.asarray(y, float), np.asarray(w, float), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, x, n = blocks.pop()
            total = blocks[-1][1] + x
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * x) / total, total, blocks[-1][2] + n]
    return sign * np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, a, b of two per-query results (qid, value); raises when the ids are not the same, or one repeats."""
    sides = [x.groupBy("qid").agg(F.count("*").alias("n"), F.max("value").alias(name)).withColumn(f"{name}_n", F.col("n")).drop("n") for x, name in ((a, "a"), (b, "b"))]
    both = sides[0].join(sides[1], "qid", "full_outer")
    good = F.coalesce((F.col("a_n") == 1) & (F.col("b_n") == 1), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("query ids differ or repeat: "), F.col("qid").cast("string"))).cast("double")
    return both.select("qid", F.when(good, F.col("a")).otherwise(failed).alias("a"), F.when(good, F.col("b")).otherwise(failed).alias("b"))


def export_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, n, max_diff, same_order of two scorers' results (qid, doc_id, score) over the same candidates: ranks by score, ties by id."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    x, y = (s.select("qid", "doc_id", F.col("score").alias(n), F.row_number().over(order).alias(f"{n}_rank")) for s, n in ((a, "x"), (b, "y")))
    both = x.join(y, ["qid", "doc_id"])
    return both.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), 6).alias("max_diff"),
                                   (F.max(F.abs(F.col("x_rank") - F.col("y_rank"))) == 0).alias("same_order"))


def bootstrap_means(values: DataFrame, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """name, n, mean, lo, hi: percentile intervals of the mean of each name's values (name, value).

    Equal values collapse to a count first, and a round draws multinomial counts over the distinct values, so the work follows
    how many values differ, not how many there are.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        v, n = group["value"].to_numpy(float), group["n"].to_numpy()
        total = int(n.sum())
        means = np.random.default_rng(seed).multinomial(total, n / total, size=rounds) @ v / total
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"name": [group["name"].iloc[0]], "n": [total], "mean": [round(float(n @ v) / total, 6)], "lo": [round(lo, 6)], "hi": [round(hi, 6)]})

    counts = values.filter("value IS NOT NULL").groupBy("name", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    return counts.groupBy("name").applyInPandas(run, "name string, n long, mean double, lo double, hi double")
