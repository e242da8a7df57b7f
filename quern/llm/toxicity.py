"""Toxicity by maximum-scoring segments of token log-odds.

Every token's score is its log-odds ratio between toxic and clean labelled texts under an informative
Dirichlet prior (pooled token rates worth ``PRIOR`` of the labelled texts); tokens whose ratio is at least
``MIN_ODDS`` and ``MIN_Z`` standard errors above zero score, all others cost ``DRIFT``; a token that repeats the one
before it costs it too, so that stuttering junk builds no segment. A linear-time scan finds all maximal scoring
segments of a text. Under the clean background, segment scores follow extreme-value statistics:
lambda is the positive root of E[exp(lambda * score)] = 1, and a segment of score S in n tokens has the
expected number n * K * exp(-lambda S); those expected less than ``ALPHA`` times are the text's toxic passages.
The r best segments together have the Poisson-limit tail exp(-T) T^(r-1) / (r! (r-1)!) with T the sum of their
normalised scores; the text's evidence is the largest -ln of it over r, and a logistic curve fitted on labelled
texts turns evidence into a probability.

Bounds: the model is fitted on about ``TRAIN_DOCS`` distinct labelled texts, chosen by hash (all, if fewer), its
curve on about ``FIT_DOCS`` of them; the tokens that are broadcast are some of those texts' tokens.

Defined cases: null and empty texts have no segment and get the curve's score at zero evidence; a document
labelled twice is toxic if one label says so; labels without a document or with null toxic are ignored; without
both classes the score is 0 for all; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.storage import materialise
from quern.llm.wordhash import PUNCTUATION, words

PRIOR, MIN_Z, MIN_ODDS, DRIFT, CAP, ALPHA, K = 0.05, 2.5, 2.0, 0.1, 6.0, 0.05, 0.1
TRAIN_DOCS, FIT_DOCS, RIDGE = 200_000, 20_000, 0.05


def _tokens(texts):
    return words([t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts], PUNCTUATION)


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, end), in one pass over ``scores``.

    Open candidates lie on a stack with the running total before and after them; a new one swallows back
    to the nearest candidate that starts lower, as long as the join would score more.
    """
    total, stack = 0.0, []
    for at, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        segment = (before, total, at, at + 1)
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= segment[0]:
                k -= 1
            if k < 0 or stack[k][1] >= segment[1]:
                break
            segment = (stack[k][0], segment[1], stack[k][2], segment[3])
            del stack[k:]
        stack.append(segment)
    return [(high - low, a, b) for low, high, a, b in stack]


class Model:
    """Sorted token hashes with their scores, the extreme-value constants and the logistic curve."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray, background: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], scores[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.rate = self._rate(scores, background)
        self.curve = (0.0, 0.0)

    @staticmethod
    def _rate(scores: np.ndarray, background: np.ndarray) -> float:
        """Positive root of sum p exp(rate * score) = 1 over the background, by bisection."""
        rest = max(1.0 - background.sum(), 0.0)
        lo, hi = 0.0, 20.0
        for _ in range(60):
            mid = (lo + hi) / 2
            value = (background * np.exp(np.minimum(mid * scores, 300))).sum() + rest * np.exp(-mid * DRIFT)
            lo, hi = (mid, hi) if value < 1 else (lo, mid)
        return lo

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of scoring tokens and their scores."""
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        real = (self.hashes[at] == h[maybe]) & ((maybe == 0) | (h[maybe] != h[maybe - 1]))
        return maybe[real], self.scores[at[real]]

    def segments(self, places: np.ndarray, scores: np.ndarray, n: int) -> list[tuple[float, int, int]]:
        """(normalised score, first token, end token) of the maximal segments of one text of n tokens.

        Between two scoring tokens lies one run of drift, so the scan is linear in the scoring tokens.
        """
        gaps = np.diff(places, prepend=-1) - 1
        line = np.empty(2 * len(places))
        line[::2], line[1::2] = -DRIFT * gaps, scores
        shift = np.log(max(K * n, 1.0))
        return [(self.rate * s - shift, int(places[a // 2]), int(places[b // 2 - 1]) + 1) for s, a, b in maximal_segments(line.tolist())]

    @staticmethod
    def together(normal: list[float]) -> float:
        """The largest -ln tail of the sums of the best segments; 0 if none is above chance."""
        best, total, factors = 0.0, 0.0, 0.0
        for r, s in enumerate(sorted(normal, reverse=True), 1):
            if s <= 0:
                break
            total += s
            factors += np.log(r) + (np.log(r - 1) if r > 1 else 0.0)
            best = max(best, total + factors - (r - 1) * np.log(max(total, 1.0)))
        return best

    def evidence(self, texts) -> tuple[np.ndarray, list]:
        """Each text's evidence and its significant passages as (-ln expected number, first, end)."""
        h, bounds = _tokens(texts)
        places, scores = self.hits(h)
        cut = np.searchsorted(places, bounds)
        total, found = np.zeros(len(bounds) - 1), [[] for _ in range(len(bounds) - 1)]
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[k], cut[k + 1]
            all_ = self.segments(places[a:b] - bounds[k], scores[a:b], int(bounds[k + 1] - bounds[k]))
            found[k] = [x for x in all_ if x[0] > -np.log(ALPHA)]
            total[k] = self.together([e for e, _, _ in all_])
        return total, found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-(a + b * np.log1p(evidence))))

    def fit(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Ridge logistic regression on log(1 + evidence), by Newton's method."""
        x = np.column_stack((np.ones(len(evidence)), np.log1p(evidence)))
        w = np.zeros(2)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-x @ w))
            grad = x.T @ (toxic - p) - RIDGE * w
            hess = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
            step = np.linalg.solve(hess, grad)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(w[0]), float(w[1]))


def _below(column: str, share: float):
    """Rows whose hash of ``column`` falls into the given share."""
    return F.pmod(F.xxhash64(F.lit("pick"), column), F.lit(1_000_000)) < int(min(share, 1.0) * 1_000_000)


def train_model(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) names."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Copies of a text count once; only ids and hashes move here.
    distinct = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id")
    chosen = materialise(distinct.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxic-train")
    n = chosen.count()
    ids = chosen.filter(_below("h", TRAIN_DOCS / max(n, 1))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    # About TRAIN_DOCS rows at most, so the broadcast is bounded and no text is shuffled.
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush():
            h = np.concatenate([x for x, _, _ in held])
            unique, at = np.unique(h, return_inverse=True)
            y1, y0 = (np.bincount(at, np.concatenate([x[k] for x in held])) for k in (1, 2))
            return [(unique, y1, y0)]

        for batch in batches:
            h, bounds = _tokens(batch["text"])
            for a, b, toxic in zip(bounds[:-1], bounds[1:], batch["toxic"], strict=True):
                u = np.unique(h[a:b])
                held.append((u, np.full(len(u), float(toxic == 1)), np.full(len(u), float(toxic != 1))))
                size += len(u)
            if size > 1 << 20:
                held = flush()
                size = len(held[0][0])
                if size > 1 << 19:
                    yield pd.DataFrame({"token": held[0][0].view(np.int64), "y1": held[0][1], "y0": held[0][2]})
                    held, size = [], 0
        if held:
            held = flush()
            yield pd.DataFrame({"token": held[0][0].view(np.int64), "y1": held[0][1], "y0": held[0][2]})

    totals = ids.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") != 1).cast("long"))).first()
    n1, n0 = totals[0] or 0, totals[1] or 0
    if not n1 or not n0:
        return None
    counts = train.mapInPandas(count, "token long, y1 double, y0 double").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    prior = max(PRIOR * (n1 + n0), 1.0)
    odds = (
        counts.withColumn("p", F.expr(f"{prior}D * (y1 + y0) / {float(n1 + n0)}D"))
        .withColumn("d", F.expr(f"ln((y1 + p) / ({n1 + prior}D - y1 - p + 1e-9D)) - ln((y0 + p) / ({n0 + prior}D - y0 - p + 1e-9D))"))
        .withColumn("z", F.expr("d / sqrt(1 / (y1 + p) + 1 / (y0 + p))")).filter((F.col("z") >= MIN_Z) & (F.col("d") >= MIN_ODDS))
        .select("token", "d", "y0", "p").orderBy("token").toPandas()  # significant tokens of at most about TRAIN_DOCS texts
    )
    background = ((odds["y0"] + odds["p"]) / (n0 + prior) / 100.0).to_numpy()  # a text holds about a hundred tokens
    model = Model(odds["token"].to_numpy().view(np.uint64), np.minimum(odds["d"].to_numpy(), CAP), background)
    sample = train.filter(_below("doc_id", FIT_DOCS / max(min(n, TRAIN_DOCS), 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"evidence": shared.value.evidence(batch["text"])[0], "toxic": batch["toxic"].astype(float)})

    fitted = sample.mapInPandas(measure, "evidence double, toxic double").toPandas()
    model.fit(fitted["evidence"].to_numpy(), (fitted["toxic"] == 1).to_numpy().astype(float))
    return model


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, score and passages: the significant segments, in tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if shared.value is None:
                p, found = np.zeros(len(texts)), [[] for _ in texts]
            else:
                evidence, found = shared.value.evidence(texts)
                p = shared.value.probability(evidence)
            spans = [[{"evidence": float(e), "first": a, "end": b} for e, a, b in x] for x in found]
            kind = pa.list_(pa.struct([("evidence", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, passages array<struct<evidence: double, first: long, end: long>>")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages; learned from labels that are not held out."""
    model = train_model(docs, labels.filter(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
