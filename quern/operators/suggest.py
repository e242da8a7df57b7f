"""Completion and spelling from a query log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import correctable, deletes


def query_counts(log: DataFrame) -> DataFrame:
    """query and n of a log with one column ``query`` already normalised."""
    return log.filter("query <> ''").groupBy("query").agg(F.count("*").alias("n"))


def completions(counts: DataFrame, k: int = 10) -> DataFrame:
    """Top k queries under every prefix, the empty and the whole query among them, count descending then query: prefix, rank, query, n.

    Prefixes are ranked with a pruned window, so a popular prefix sends k rows a task.
    """
    prefixes = counts.select("query", "n", F.explode(F.expr("sequence(0, length(query))")).alias("l"))
    keyed = prefixes.select(F.expr("substring(query, 1, l)").alias("prefix"), "query", "n")
    order = W.partitionBy("prefix").orderBy(F.desc("n"), "query")
    return keyed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("prefix", "rank", "query", "n")


def spell_candidates(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word and candidate pairs that share a deletion of up to two characters: the candidates of symmetric-delete search."""
    left = words.filter(correctable(F.col("word"))).select("word", F.explode(deletes(F.col("word"))).alias("key"))
    right = vocabulary.filter(correctable(F.col("word"))).select(F.col("word").alias("candidate"), "n", F.explode(deletes(F.col("word"))).alias("key"))
    return left.join(right, "key").filter("word <> candidate").select("word", "candidate", "n").distinct()


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (adjacent transpositions once), or most + 1 beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def correct(words: DataFrame, vocabulary: DataFrame, most: int = 2, least_count: int = 3) -> DataFrame:
    """word and its best correction: least distance, then most frequent, then first in order; known words stay."""
    known = vocabulary.filter(F.col("n") >= least_count)
    unknown = words.distinct().join(known.select("word"), "word", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(distance=[osa(a, b, most) for a, b in zip(batch["word"], batch["candidate"], strict=True)])

    near = spell_candidates(unknown, known).filter(F.levenshtein("word", "candidate") <= 2 * most)
    scored = near.mapInPandas(run, "word string, candidate string, n long, distance long").filter(F.col("distance") <= most)
    order = W.partitionBy("word").orderBy("distance", F.desc("n"), "candidate")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1").select("word", "candidate", "distance", "n")


def lookup(counts: DataFrame, prefixes: DataFrame, k: int = 5) -> DataFrame:
    """Top k completions of the asked prefixes (prefix), already normalised: prefix, rank, query, n. The empty prefix asks for the top of all.

    Only the asked lengths of each logged query are made, and only asked prefixes are ranked.
    """
    asked = prefixes.select("prefix").distinct()
    lengths = [r[0] for r in asked.select(F.length("prefix").alias("l")).distinct().collect()]  # at most one a query length
    heads = counts.select("query", "n", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(-1)])).alias("l")).filter("l >= 0 AND l <= length(query)")
    keyed = heads.select(F.expr("substring(query, 1, l)").alias("prefix"), "query", "n").join(asked, "prefix", "left_semi")
    order = W.partitionBy("prefix").orderBy(F.desc("n"), "query")
    return keyed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("prefix", "rank", "query", "n")


def prefix_span(prefix, query):
    """(start, end) in characters of a suggestion that its prefix covers; an empty span where it does not begin with it."""
    return F.struct(F.lit(0).alias("start"), F.when(F.startswith(query, prefix), F.length(prefix)).otherwise(0).alias("end"))


def suggest_queries(queries: DataFrame, corrections: DataFrame) -> DataFrame:
    """qid and suggestion: the query's words (qid, pos, word) with corrections (word, candidate) put in; null where none applies."""
    fixed = queries.join(corrections.select("word", "candidate"), "word", "left")
    whole = fixed.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("candidate", "word").alias("w")))).alias("words"), F.max(F.col("candidate").isNotNull()).alias("changed"))
    return whole.select("qid", F.when(F.col("changed"), F.array_join("words.w", " ")).alias("suggestion"))


def did_you_mean(suggestions: DataFrame, queries: DataFrame, log: DataFrame) -> DataFrame:
    """The suggestions of queries (qid, query) that the log (query) does not hold."""
    unknown = queries.join(log.select("query").distinct(), "query", "left_anti").select("qid")
    return suggestions.filter("suggestion IS NOT NULL").join(unknown, "qid", "left_semi")
