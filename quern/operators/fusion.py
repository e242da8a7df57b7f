"""Fusing ranked lists, reranking cascades and merging slices. Runs are (qid, doc_id, rank, score)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.lexical import top_k


def truncate(run: DataFrame, depth: int) -> DataFrame:
    return run.filter(F.col("rank") <= depth)


def reciprocal_rank(runs: list[DataFrame], k: float = 60.0) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; of a repeated document the first occurrence counts."""
    first = [r.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank")) for r in runs]
    every = reduce(DataFrame.unionByName, first)
    return every.groupBy("qid", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))


def normalise(run: DataFrame, method: str) -> DataFrame:
    """``run`` with ``norm``: min-max (a constant list is 1) or z-score (population; a constant list is 0)."""
    w = W.partitionBy("qid")
    s = F.col("score")
    if method == "minmax":
        low, high = F.min("score").over(w), F.max("score").over(w)
        return run.withColumn("norm", F.when(high > low, (s - low) / (high - low)).otherwise(1.0))
    if method == "zscore":
        mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
        return run.withColumn("norm", F.when(sd > 0, (s - mean) / sd).otherwise(0.0))
    raise ValueError(method)


def weighted(lexical: DataFrame, dense: DataFrame, alpha: float = 0.8, method: str = "zscore") -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical; a document that a list lacks takes that list's minimum, an empty list 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    sides = []
    for run, name in ((lexical, "l"), (dense, "d")):
        sides.append((normalise(run, method).select("qid", "doc_id", F.col("norm").alias(name)), name))
    (left, _), (right, _) = sides
    both = left.join(right, ["qid", "doc_id"], "full_outer")
    w = W.partitionBy("qid")
    value = {n: F.coalesce(F.col(n), F.min(n).over(w), F.lit(0.0)) for n in ("l", "d")}
    score = F.lit(alpha) * value["d"] + F.lit(1.0 - alpha) * value["l"]
    return both.select("qid", "doc_id", F.round(score, 6).alias("score"))


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 10, method: str = "weighted", alpha: float = 0.8, norm: str = "zscore", rrf_k: float = 60.0, depth: int = 100) -> DataFrame:
    """The top k of the fused lists; defaults are those of serving."""
    lists = truncate(lexical, depth), truncate(dense, depth)
    fused = reciprocal_rank(list(lists), rrf_k) if method == "rrf" else weighted(*lists, alpha=alpha, method=norm)
    return top_k(fused, k)


def merge_top_k(slices: DataFrame, k: int) -> DataFrame:
    """Top k over slices (qid, doc_id, score): a document in several keeps its best score."""
    return top_k(slices.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), k)


def cascade(run: DataFrame, scores: DataFrame, head: int) -> DataFrame:
    """Reorder the first ``head`` by ``scores`` (qid, doc_id, rerank), missing scores last, ties as before; the tail stays."""
    joined = run.join(scores, ["qid", "doc_id"], "left")
    order = W.partitionBy("qid").orderBy((F.col("rank") <= head).desc(), F.when(F.col("rank") <= head, F.col("rerank")).desc_nulls_last(), "rank")
    return joined.withColumn("new_rank", F.row_number().over(order))


def grid(lexical: DataFrame, dense: DataFrame, alphas: list[float], norms=("minmax", "zscore")) -> DataFrame:
    """Weighted fusion under every configuration of a small grid: config, qid, doc_id, score."""
    frames = [weighted(lexical, dense, a, n).withColumn("config", F.lit(f"{n}-{a}")) for n in norms for a in alphas]
    return reduce(DataFrame.unionByName, frames)


def assemble(final: DataFrame, **stages: DataFrame) -> DataFrame:
    """Final ranking with every stage's score and rank, null where a stage lacks the document."""
    out = final
    for name, run in stages.items():
        out = out.join(run.select("qid", "doc_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank")), ["qid", "doc_id"], "left")
    return out


def rerank_pool(*arms: DataFrame, depth: int = 20) -> DataFrame:
    """Distinct (qid, doc_id) of the first ``depth`` of every arm: what a reranker scores once."""
    return reduce(DataFrame.unionByName, [truncate(a, depth).select("qid", "doc_id") for a in arms]).distinct()


def by_mode(modes: DataFrame, lexical: DataFrame, dense: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Top k under each query's mode (qid, mode: lexical, dense or hybrid), which falls back to lexical where the dense list is empty: qid, mode, doc_id, rank, score."""
    some = dense.select("qid").distinct().withColumn("has", F.lit(True))
    used = modes.join(some, "qid", "left").select("qid", F.when(F.col("has") & F.col("mode").isin("dense", "hybrid"), F.col("mode")).otherwise("lexical").alias("mode"))
    of = lambda mode: used.filter(F.col("mode") == mode).select("qid")
    arms = [top_k(lexical.join(of("lexical"), "qid", "left_semi").drop("rank"), k), top_k(dense.join(of("dense"), "qid", "left_semi").drop("rank"), k),
            fuse(lexical.join(of("hybrid"), "qid", "left_semi"), dense.join(of("hybrid"), "qid", "left_semi"), k=k, **kw)]
    found = reduce(DataFrame.unionByName, [a.select("qid", "doc_id", "rank", "score") for a in arms])
    return found.join(used, "qid").select("qid", "mode", "doc_id", "rank", "score")


def progressive(first: DataFrame, final: DataFrame) -> DataFrame:
    """The two frames of a progressive result in one: stage (lexical, then final), qid, doc_id, rank, score."""
    cols = ["qid", "doc_id", "rank", "score"]
    return first.select(F.lit("lexical").alias("stage"), *cols).unionByName(final.select(F.lit("final").alias("stage"), *cols))


def score_pairs(pairs: DataFrame, scorer, batch: int = 256) -> DataFrame:
    """qid, doc_id, rerank of pairs (qid, doc_id, query, text) under a pluggable scorer.

    ``scorer`` is called once a task and returns a function from two lists of strings to scores; a two-column result is taken as the
    logits of a two-class head, whose difference is the score. It sees at most ``batch`` pairs at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for frame in batches:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                values = np.asarray(score(part["query"].tolist(), part["text"].tolist()), dtype=float)
                values = values[:, 1] - values[:, 0] if values.ndim == 2 else values
                yield part[["qid", "doc_id"]].assign(rerank=values)

    return pairs.select("qid", "doc_id", "query", "text").mapInPandas(run, "qid long, doc_id long, rerank double")
