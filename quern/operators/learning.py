"""Counterfactual learning to rank and negative mining."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def features(candidates: DataFrame, lexical: DataFrame, dense: DataFrame, queries: DataFrame, lengths: DataFrame) -> DataFrame:
    """Seven features of every candidate (qid, doc_id): z-scores with a floor half below the minimum, reciprocal ranks, log length, query-length products."""
    sides = candidates.select("qid", "doc_id")
    for run, n in ((lexical, "l"), (dense, "d")):
        stats = run.groupBy("qid").agg(F.avg("score").alias(f"{n}_mean"), (F.stddev_pop("score") + 1e-9).alias(f"{n}_sd"), F.min("score").alias(f"{n}_min"))
        sides = sides.join(run.select("qid", "doc_id", F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank")), ["qid", "doc_id"], "left").join(stats, "qid", "left")
    z = lambda n: F.coalesce((F.col(f"{n}_score") - F.col(f"{n}_mean")) / F.col(f"{n}_sd"), (F.col(f"{n}_min") - F.col(f"{n}_mean")) / F.col(f"{n}_sd") - 0.5, F.lit(-0.5))
    joined = sides.join(lengths.select("doc_id", "dl"), "doc_id", "left").join(queries.select("qid", "n_words"), "qid", "left")
    words = F.log1p(F.coalesce("n_words", F.lit(0)).cast("double"))
    r = lambda c: F.round(c, 6)
    return joined.select(
        "qid", "doc_id", r(z("l")).alias("z_lexical"), r(z("d")).alias("z_dense"), r(F.coalesce(1.0 / F.col("l_rank"), F.lit(0.0))).alias("rr_lexical"),
        r(F.coalesce(1.0 / F.col("d_rank"), F.lit(0.0))).alias("rr_dense"), r(F.log1p(F.coalesce("dl", F.lit(0)).cast("double"))).alias("log_length"),
        r(words * z("l")).alias("words_lexical"), r(words * z("d")).alias("words_dense"))


def ips_weights(clicks: DataFrame, propensity: DataFrame, clip: float = 100.0) -> DataFrame:
    """qid, doc_id, naive clicks and inverse-propensity weight: sum of clicks * min(1 / eta_rank, clip)."""
    joined = clicks.join(propensity, "rank")
    return joined.groupBy("qid", "doc_id").agg(F.sum("clicks").alias("naive"), F.round(F.sum(F.col("clicks") * F.least(1.0 / F.col("eta"), F.lit(clip))), 6).alias("weight"))


def swap_propensity(sessions: DataFrame) -> DataFrame:
    """rank, eta from swap interventions: sessions (rank k, swapped, clicked): the click rate of the top document at k over its rate at 1."""
    rate = sessions.groupBy("rank").agg(F.avg(F.when(F.col("swapped") == 1, F.col("clicked"))).alias("at_k"), F.avg(F.when(F.col("swapped") == 0, F.col("clicked"))).alias("at_1"))
    raw = F.when(F.col("rank") == 1, 1.0).when(F.col("at_1") > 0, F.col("at_k") / F.col("at_1"))
    return rate.select("rank", F.round(raw, 6).alias("eta"))


def filled(propensity: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Missing and non-positive ranks take the last value before them, 1 at the start; never below ``floor``."""
    order = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # as many rows as a page has ranks
    good = F.when(F.col("eta") > 0, F.col("eta"))
    return propensity.select("rank", F.greatest(F.coalesce(F.last(good, ignorenulls=True).over(order), F.lit(1.0)), F.lit(floor)).alias("eta"))


def listwise_fit(data: pd.DataFrame, names: list[str], l2: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """A linear ranker on the softmax list loss by gradient descent with backtracking; ``data``: qid, weight and features, bounded by the caller."""
    x, y, q = data[names].to_numpy(float), data["weight"].to_numpy(float), pd.factorize(data["qid"])[0]
    n = q.max() + 1 if len(q) else 0
    total = np.bincount(q, y, n)

    def loss(w):
        s = x @ w
        top = np.full(n, -np.inf)
        np.maximum.at(top, q, s)
        e = np.exp(s - top[q])
        z = np.bincount(q, e, n)
        p = e / z[q]
        value = -(y * (s - top[q] - np.log(z[q]))).sum() / max(y.sum(), 1e-9) + l2 * w @ w / 2
        return value, x.T @ (total[q] * p - y) / max(y.sum(), 1e-9) + l2 * w

    w, step = np.zeros(x.shape[1]), 1.0
    value, grad = loss(w)
    for _ in range(rounds):
        while step > 1e-10:
            new = w - step * grad
            v, g = loss(new)
            if v <= value - 0.5 * step * grad @ grad:
                w, value, grad, step = new, v, g, step * 2
                break
            step /= 2
        if np.abs(grad).max() < 1e-7:
            break
    return w


def hard_negatives(lexical: DataFrame, dense: DataFrame, qrels: DataFrame, depth: int = 30, dense_margin: float = 0.0, lexical_margin: float = 0.0) -> DataFrame:
    """qid, doc_id, source of candidates within ``depth`` that are not judged relevant and not likely unjudged positives.

    A candidate is dropped only if both lists score it above the best positive by the margins; a missing score keeps it.
    """
    positive = qrels.filter("grade > 0").select("qid", "doc_id")
    best = lambda run, n: run.join(positive, ["qid", "doc_id"]).groupBy("qid").agg(F.max("score").alias(n))
    pool = lexical.filter(F.col("rank") <= depth).select("qid", "doc_id", F.lit("lexical").alias("source")).unionByName(
        dense.filter(F.col("rank") <= depth).select("qid", "doc_id", F.lit("dense").alias("source")))
    scored = (
        pool.join(positive, ["qid", "doc_id"], "left_anti")
        .join(lexical.select("qid", "doc_id", F.col("score").alias("l")), ["qid", "doc_id"], "left").join(dense.select("qid", "doc_id", F.col("score").alias("d")), ["qid", "doc_id"], "left")
        .join(best(lexical, "l_best"), "qid", "left").join(best(dense, "d_best"), "qid", "left")
    )
    false_negative = (F.col("d") - F.col("d_best") >= dense_margin) & (F.col("l") - F.col("l_best") >= lexical_margin * F.abs("l_best"))
    return scored.filter(~F.coalesce(false_negative, F.lit(False))).select("qid", "doc_id", "source")


def harvest_ratios(shown: DataFrame) -> DataFrame:
    """Rank pairs with their click-rate log ratio and weight, from documents that two rankers show at different ranks.

    ``shown``: logger, qid, doc_id, rank, clicks, sessions. Such a document is equally relevant at both ranks, so the
    ratio of its click rates is the ratio of the ranks' examination.
    """
    a = shown.select("qid", "doc_id", F.col("logger").alias("la"), F.col("rank").alias("r"), "clicks", "sessions")
    b = shown.select("qid", "doc_id", F.col("logger").alias("lb"), F.col("rank").alias("s"))
    met = a.join(b, ["qid", "doc_id"]).filter("la <> lb AND r <> s").groupBy("r", "s").agg(F.sum("clicks").alias("c"), F.sum("sessions").alias("n"))
    back = met.select(F.col("s").alias("r"), F.col("r").alias("s"), F.col("c").alias("c2"), F.col("n").alias("n2"))
    both = met.join(back, ["r", "s"]).filter("r < s AND c > 0 AND c2 > 0 AND n > 0 AND n2 > 0")
    return both.select("r", "s", F.round(F.log(F.col("c") / F.col("n")) - F.log(F.col("c2") / F.col("n2")), 6).alias("log_ratio"), F.round(1.0 / (1.0 / F.col("c") + 1.0 / F.col("c2")), 6).alias("weight"))


def harvest_fit(ratios: DataFrame, ranks: int, floor: float = 1e-3) -> np.ndarray:
    """Examination by rank, eta_1 = 1, from at most ranks^2 / 2 log ratios; ranks that no ratio reaches are nan.

    The log examinations are the potentials of a weighted graph of ranks: they solve the normal equations with the
    graph's Laplacian, rank 1 held at zero.
    """
    found = ratios.filter((F.col("r") <= ranks) & (F.col("s") <= ranks)).toPandas()
    laplacian, flow = np.zeros((ranks, ranks)), np.zeros(ranks)
    ends = found[["r", "s"]].to_numpy(dtype=int) - 1
    weight, drop = found["weight"].to_numpy(dtype=float), found["log_ratio"].to_numpy(dtype=float)
    for side, sign in ((0, 1.0), (1, -1.0)):
        np.add.at(flow, ends[:, side], sign * weight * drop)
        np.add.at(laplacian, (ends[:, side], ends[:, side]), weight)
        np.add.at(laplacian, (ends[:, side], ends[:, 1 - side]), -weight)
    met = np.flatnonzero(laplacian.diagonal()[1:] > 0) + 1
    out = np.full(ranks, np.nan)
    out[0] = 1.0
    out[met] = np.maximum(np.exp(np.linalg.pinv(laplacian[np.ix_(met, met)], hermitian=True) @ flow[met]), floor)
    return out


def sampled_subset(collection: DataFrame, qrels: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """All judged-relevant documents and as many others, by seeded hash, as fill ``size``: the same subset on every run."""
    positive = qrels.filter("grade > 0").select("doc_id").distinct()
    keep = collection.join(positive, "doc_id", "left_semi")
    rest = collection.join(positive, "doc_id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max(size - keep.count(), 0))
    return keep.unionByName(rest)


def training_groups(mined: DataFrame, size: int = 8, seed: int = 1, step: int = 0) -> DataFrame:
    """qid, doc_id, slot, label: one positive and size - 1 negatives a query, drawn by a hash of (seed, step); hard negatives first.

    ``mined``: qid, doc_id, source (positive, lexical, dense, random). A document that is a positive is never a negative.
    """
    positive = mined.filter("source = 'positive'")
    negative = mined.filter("source <> 'positive'").join(positive.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    draw = F.xxhash64(F.lit(seed), F.lit(step), "qid", "doc_id")
    one = positive.withColumn("i", F.row_number().over(W.partitionBy("qid").orderBy(draw, "doc_id"))).filter("i = 1").select("qid", "doc_id", F.lit(0).alias("slot"), F.lit(1).alias("label"))
    unique = negative.groupBy("qid", "doc_id").agg(F.min((F.col("source") == "random").cast("int")).alias("late"))
    order = W.partitionBy("qid").orderBy("late", draw, "doc_id")
    others = unique.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") < size).select("qid", "doc_id", "slot", F.lit(0).alias("label"))
    return one.unionByName(others.join(one.select("qid"), "qid", "left_semi"))


def dense_for(candidates: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """qid, doc_id, rank, score of the candidates (qid, doc_id) that have a vector, by inner product with their query's: queries (qid, embedding), vectors (doc_id, embedding)."""
    asked, held = queries.select("qid", F.col("embedding").alias("q")), vectors.select("doc_id", F.col("embedding").alias("v"))
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = candidates.select("qid", "doc_id").join(asked, "qid").join(held, "doc_id").select("qid", "doc_id", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def ranked_lists(scored: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid and nDCG@k of lists scored by a model: scored (qid, doc_id, score)."""
    from quern.operators.evaluation import ndcg

    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return ndcg(scored.withColumn("rank", F.row_number().over(order)), qrels, k)
