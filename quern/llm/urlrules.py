"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages are shrunk through a chain of beta-binomial priors, suffix -> registered
domain -> host. The strength of each level's prior is estimated from the spread of that level's own
rates (method of moments), so a level whose members behave alike shrinks hard and one whose members
differ shrinks little. A host is blocked when the lower posterior bound of its bad-page rate is above
``threshold``. A host without labels is judged by what its domain and suffix, or all pages, let expect.

Defined cases: a null url, or one without ``://``, has the empty host and path and is judged as host
``''``; labels with null ``quality`` and null ``toxic`` are no evidence; repeated labels count as often
as they occur; an empty label table leaves every host at the prior mean 0.5, which allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split_url(url):
    """Host (A-Z lower-cased) and path of a url column; both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_columns(host, path, rules=DEFAULT_RULES):
    """The longest fitting rule and its verdict (both null where none fits)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later tests win
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, p: float, least: float, most: float) -> float:
    """The prior's weight from the spread of the level's own rates about ``p``, by the method of moments."""
    spread = F.col("n") * (F.col("k") / F.col("n") - F.lit(p)) * (F.col("k") / F.col("n") - F.lit(p))
    m = level.filter("n > 0").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(spread).alias("spread")).first()
    if not m["m"]:
        return most
    v, room = p * (1 - p), m["total"] - m["squares"] / m["total"]
    tau = (m["spread"] - (m["m"] - 1) * v) / room if m["m"] > 1 and room > 0 else 0.0
    return most if tau <= v / (most + 1) else max(v / tau - 1, least)


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = 1.645, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """Posterior of every host's bad-page rate. ``pages`` has page_id and host; ``labels`` doc_id, quality, toxic.

    A page is bad when its label says low quality or toxic. Only (page_id, host) and the label columns
    move; counts are combined before each shuffle, so a host with a third of the pages is one row per task.
    """
    judged = labels.select(F.col("doc_id").alias("page_id"), F.when(
        F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)), 1
    ).otherwise(0).alias("bad"), (F.col("quality").isNotNull() | F.col("toxic").isNotNull()).alias("known"))
    outcomes = pages.join(judged.filter("known"), "page_id").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    hosts = pages.select("host").distinct().join(outcomes, "host", "left").fillna(0.0, ["n", "k"]).select(
        "host", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0).alias("domain"), F.regexp_extract("host", "[^.]*$", 0).alias("suffix"), "n", "k")
    # A row a host, domain and suffix; all else is computed from these.
    h = materialise(hosts, "hosts")
    d = materialise(h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    s = materialise(d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    total = s.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p = 0.5 if total["n"] is None else (total["k"] + 1) / (total["n"] + 2)
    wh, wd, ws = (_strength(level, p, least, most) for level in (h, d, s))
    shrunk = lambda w, mean: (F.col("k") + F.lit(w) * mean) / (F.col("n") + F.lit(w))
    sp = s.select("suffix", shrunk(ws, F.lit(p)).alias("suffix_mean"))
    dp = d.join(sp, "suffix").select("domain", shrunk(wd, F.col("suffix_mean")).alias("domain_mean"))
    hp = h.join(dp, "domain").select("host", (F.col("n") + F.lit(wh)).alias("size"), shrunk(wh, F.col("domain_mean")).alias("mean"))
    return hp.withColumn("lower_bound", F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1)))


def judge(pages: DataFrame, labels: DataFrame, rules=DEFAULT_RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound for every row of ``pages`` (page_id, url)."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = host_reputation(split.select("page_id", "host"), labels, z).select("host", "lower_bound")
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("lower_bound") > threshold, "block").otherwise("allow"))
    return split.join(reputation, "host").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round("lower_bound", 6).alias("bad_bound"))
