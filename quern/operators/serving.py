"""Serving-time decisions replayed over request logs: degradation plans, routing, latency, dwell, availability, trace ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pressure_level(in_flight: Column, thresholds: list[int]) -> Column:
    """How many of up to three thresholds the load exceeds: the level of the highest one exceeded."""
    level = F.lit(0)
    for i, t in enumerate(thresholds[:3], 1):
        level = F.when(in_flight > t, i).otherwise(level)
    return level


def cost(level: int, dense: Column, rerank: Column) -> Column:
    """Estimated milliseconds of a plan at a degradation level, from the request's cost columns."""
    used = dense if level < 3 else F.lit(False)
    shard = F.when(used, F.col("shard_shrunk_ms" if level >= 2 else "shard_full_ms")).otherwise(F.col("shard_lexical_ms"))
    again = F.when(rerank, F.col("rerank_ms")).otherwise(0.0) if level < 1 else F.lit(0.0)
    return F.when(used, F.col("encode_ms")).otherwise(0.0) + shard + again + F.col("fetch_ms")


def degradation_plan(requests: DataFrame) -> DataFrame:
    """``requests`` (dense, rerank, lexical, encoder_ok, vectors_ok, reranker_ok, remaining_ms, pressure, probe and cost columns) with the plan chosen.

    The least degraded level, not below the load's, whose cost fits; level 1 drops reranking, 2 shrinks the beam, 3 leaves lexical only.
    """
    c = F.col
    dense = c("dense") & c("encoder_ok") & c("vectors_ok")
    rerank = c("rerank") & c("reranker_ok")
    floor = F.greatest(F.lit(0), F.least(F.lit(3), c("pressure")))
    level = F.lit(3)
    for n in (2, 1, 0):
        level = F.when((floor <= n) & (c("probe") | (cost(n, dense, rerank) <= c("remaining_ms"))), n).otherwise(level)
    planned = requests.withColumn("level", F.greatest(level, floor)).withColumn("_dense", dense).withColumn("_rerank", rerank)
    return planned.select(
        *requests.columns, "level", (c("_dense") & (c("level") < 3)).alias("use_dense"), (c("_dense") & (c("level") == 2)).alias("shrink_beam"),
        (c("_rerank") & (c("level") < 1)).alias("use_rerank"), (c("lexical") | ~(c("_dense") & (c("level") < 3))).alias("use_lexical"))


def shard_of(doc_id: Column, shards: int) -> Column:
    return F.pmod(doc_id, F.lit(shards))


def range_shard(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """``docs`` with the shard whose [low, high] range holds the id; bounds are one row a shard."""
    return docs.join(F.broadcast(bounds), (docs["doc_id"] >= bounds["low"]) & (docs["doc_id"] <= bounds["high"]), "left").drop("low", "high")


def rolling_latency(samples: DataFrame, window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """start, n, p50, p95 of samples (ts, ms) in sliding windows."""
    w = samples.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"))
    return w.select(F.col("w.start").alias("start"), "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def dwell(events: DataFrame) -> DataFrame:
    """session_id, event_id, dwell_us: microseconds from each click to the session's next event of any type; null at the end of the log."""
    w = W.partitionBy("session_id").orderBy("ts", "event_id")
    nxt = events.withColumn("next_ts", F.lead("ts").over(w)).filter("type = 'click'")
    return nxt.select("session_id", "event_id", (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("dwell_us"))


def abandoned(pages: DataFrame) -> DataFrame:
    return pages.filter("clicks = 0").select("request_id")


def availability(samples: DataFrame) -> DataFrame:
    """Per phase: requests, error rate, latency percentiles, degraded rate among answered, mean reciprocal rank with errors as 0."""
    ok = F.col("status") == 200
    agg = samples.groupBy("phase").agg(
        F.count("*").alias("requests"), F.round(F.avg((~ok).cast("double")), 6).alias("error_rate"), F.round(F.percentile("latency_ms", 0.5), 6).alias("p50"),
        F.round(F.percentile("latency_ms", 0.99), 6).alias("p99"), F.round(F.sum((ok & (F.col("degradation") > 0)).cast("double")) / F.count("*"), 6).alias("degraded_rate"),
        F.round(F.avg(F.when(ok, F.coalesce(1.0 / F.col("first_relevant"), F.lit(0.0))).otherwise(0.0)), 6).alias("mrr"))
    return agg


def score_agreement(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Pairs in both runs, in one only, and how many scores agree after rounding to four places."""
    j = a.select("qid", "doc_id", F.col("score").alias("x")).join(b.select("qid", "doc_id", F.col("score").alias("y")), ["qid", "doc_id"], "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    gap = F.abs(F.round("x", 4) - F.round("y", 4))
    return j.agg(F.count(F.when(both, 1)).alias("pairs"), F.count(F.when(F.col("y").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_b"),
                 F.count(F.when(both & (gap <= tolerance * 1.01), 1)).alias("within"), F.round(F.max(gap), 6).alias("largest"))


def matched_recall(points: DataFrame, target: float) -> DataFrame:
    """name and cost where the recall curve of points (name, recall, cost) first reaches the target, linear between points."""
    w = W.partitionBy("name").orderBy("recall")
    step = points.withColumn("r0", F.lag("recall").over(w)).withColumn("c0", F.lag("cost").over(w)).filter(F.col("recall") >= target)
    first = step.withColumn("i", F.row_number().over(w)).filter("i = 1")
    value = F.when(F.col("r0").isNull() | (F.col("recall") == F.col("r0")), F.col("cost")).otherwise(
        F.col("c0") + (F.lit(target) - F.col("r0")) * (F.col("cost") - F.col("c0")) / (F.col("recall") - F.col("r0")))
    return first.select("name", F.round(value, 6).alias("cost"))


def traceparent(value: Column) -> Column:
    """trace_id, span_id and sampled of a W3C traceparent header; null if it is malformed or all zero."""
    pattern = "^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    part = lambda i: F.regexp_extract(value, pattern, i)
    good = value.rlike(pattern) & (part(1) != "0" * 32) & (part(2) != "0" * 16)
    return F.when(good, F.struct(part(1).alias("trace_id"), part(2).alias("span_id"), (F.conv(part(3), 16, 10).cast("int").bitwiseAND(1) == 1).alias("sampled")))


# What a user is told at each level of degradation.
NOTICES = ("", "Results are not reranked.", "Results are searched less deeply.", "Results are matched by words only.")


def notices(plan: DataFrame) -> DataFrame:
    """``plan`` (level) with the notice its level shows."""
    return plan.withColumn("notice", F.element_at(F.array(*[F.lit(x) for x in NOTICES]), F.col("level") + 1))


def validate_requests(requests: DataFrame, most_k: int = 100, longest: int = 512) -> DataFrame:
    """``requests`` (q, k, mode) with defaults put in (k 10, mode hybrid) and ``error``: the first rule a request breaks, null if none."""
    k, mode, q = F.coalesce("k", F.lit(10)), F.coalesce("mode", F.lit("hybrid")), F.trim(F.coalesce("q", F.lit("")))
    error = F.when(q == "", "q").when(F.length(q) > longest, "q").when(~k.between(1, most_k), "k").when(~mode.isin("lexical", "dense", "hybrid"), "mode")
    return requests.withColumn("q", q).withColumn("k", k).withColumn("mode", mode).withColumn("error", error)


def without(df: DataFrame, *prefixes: str) -> DataFrame:
    """``df`` without the columns that begin with one of the prefixes: timings that differ from run to run."""
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])
