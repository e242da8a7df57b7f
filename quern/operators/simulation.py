"""Simulated traffic, rankers and click logs, and the statistics that plan experiments.

Randomness is a hash of ids and a seed, so a simulation is the same on any number of partitions.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.evaluation import isotonic, normal_tail
from quern.operators.experiments import _uniform, simulate_clicks


def gaussian(*keys):
    """A standard normal number from a hash of the keys (Box-Muller)."""
    u = F.greatest(_uniform(F.lit("u"), *keys), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * _uniform(F.lit("v"), *keys))


def noisy_oracle(qrels: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """A ranker that sees grades through Gaussian noise: qid, doc_id, score, rank."""
    scored = qrels.select("qid", "doc_id", (F.col("grade") + sigma * gaussian(F.lit(seed), "qid", "doc_id")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def traffic(spark: SparkSession, impressions: int, ranking: DataFrame, k: int = 10, seed: int = 1, **model) -> DataFrame:
    """``impressions`` pages of random queries of ``ranking`` (qid number from 0, doc_id, rank, grade) with simulated clicks."""
    queries = ranking.agg(F.max("qid") + 1).first()[0]
    pages = spark.range(impressions).select(F.col("id").alias("page"), F.floor(_uniform(F.lit(seed), F.lit("query"), "id") * queries).alias("qid"))
    shown = pages.join(ranking.filter(F.col("rank") <= k), "qid")
    return simulate_clicks(shown, seed=seed, **model)


def swap_logs(spark: SparkSession, sessions: int, ranking: DataFrame, share: float = 0.05, k: int = 10, seed: int = 1, **model) -> DataFrame:
    """Sessions in which, with probability ``share``, the top document trades places with a random rank or (control) stays.

    page, qid, doc_id, rank (as shown), swap_rank (null: no intervention), swapped, clicked.
    """
    queries = ranking.agg(F.max("qid") + 1).first()[0]
    u = lambda name: _uniform(F.lit(seed), F.lit(name), "id")
    pages = spark.range(sessions).select(F.col("id").alias("page"), F.floor(u("query") * queries).alias("qid"),
                                         F.when(u("take") < share, (F.floor(u("rank") * (k - 1)) + 2).cast("int")).alias("swap_rank"), (u("do") < 0.5).alias("do"))
    shown = pages.join(ranking.filter(F.col("rank") <= k), "qid").withColumn("swapped", F.coalesce(F.col("do") & F.col("swap_rank").isNotNull(), F.lit(False)))
    moved = F.when(F.col("swapped") & (F.col("rank") == 1), F.col("swap_rank")).when(F.col("swapped") & (F.col("rank") == F.col("swap_rank")), 1).otherwise(F.col("rank"))
    return simulate_clicks(shown.withColumn("rank", moved).drop("do"), seed=seed, **model)


def swap_rates(logs: DataFrame) -> DataFrame:
    """rank, swapped, clicked of the top document in the intervened sessions: the input of ``learning.swap_propensity``."""
    top = logs.filter("swap_rank IS NOT NULL AND ((swapped AND rank = swap_rank) OR (NOT swapped AND rank = 1))")
    return top.select(F.col("swap_rank").alias("rank"), F.col("swapped").cast("int").alias("swapped"), F.col("clicked").cast("double").alias("clicked"))


def welch(m1: float, v1: float, n1: int, m2: float, v2: float, n2: int) -> float:
    """Two-sided p of a difference of means, normal reference."""
    se = math.sqrt(v1 / n1 + v2 / n2)
    return normal_tail((m2 - m1) / se) if se > 0 else float(m1 == m2)


def chi_square_tail(x: float, freedom: int) -> float:
    """Upper tail of the chi-square distribution, by the series of the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = freedom / 2, x / 2
    term = total = 1 / a
    for n in range(1, 10_000):
        term *= z / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def n_at_power(sizes: np.ndarray, power: np.ndarray, target: float = 0.8) -> float | None:
    """The size at which an isotonic curve through the measured powers, straight in log size, meets the target; None if it stays below."""
    curve = isotonic(power, np.ones(len(power)))
    above = int(np.searchsorted(curve, target))
    if above == len(curve):
        return None
    pair = slice(max(above - 1, 0), above + 1)
    return float(np.exp(np.interp(target, curve[pair], np.log(np.asarray(sizes, float)[pair]))))


def size_for_power(delta: float, variance: float, alpha: float = 0.05, power: float = 0.8, arms: int = 2) -> float | None:
    """Normal-approximation total size: two arms of half each with summed variance, or one sample."""
    if not delta:
        return None
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return arms * z * z * variance / (delta * delta)
