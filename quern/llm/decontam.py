"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every test item's ``SEED``-word n-grams are looked for in all documents (a bitmap of fixed size lets
almost only real seeds through, an equi-join on the n-gram hash settles them). Seeds are ranked within
their item by the number of documents that hold them, counted over the whole corpus, and the rarest
``RARE`` share of each item's seeds nominates passages; as the rank is relative, an item that is copied
into a third of the corpus keeps its seeds. Each nominated stretch of a document is aligned with its item
by Smith-Waterman over words, so copies with words replaced, dropped or added are still found, and
a document is contaminated when the best local alignment reaches ``THRESHOLD`` of a perfect copy's score.

Words are lower-cased runs of letters, digits and non-ASCII characters. Defined cases: null and empty
texts and items match nothing; an item shorter than ``SEED`` words matches only a document of exactly
those words; each text of an item_id is looked for and the best counts, repeated documents each give their rows; a null doc_id
or item_id gives no row; an empty benchmark gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.storage import materialise
from quern.llm.grid import bitmap, in_bitmap
from quern.llm.rows import keyed
from quern.llm.wordhash import PUNCTUATION, shingles, words

SEED, RARE, THRESHOLD = 3, 0.67, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1


def _lower(texts) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, gram, at) of every seed and (item_id, item) with the item's word hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, bounds = words(_lower(batch["text"]), PUNCTUATION)
            rows = []
            for item_id, s, a, b in zip(batch["item_id"], shingles(h, bounds, SEED), bounds[:-1], bounds[1:], strict=True):
                rows.append((item_id, s.tobytes(), h[a:b].tobytes()))
            yield pd.DataFrame(rows, columns=["item_id", "grams", "item"])

    one = benchmark.filter("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    items = materialise(one.mapInPandas(run, "item_id long, grams binary, item binary"), "items")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item_id, grams in zip(batch["item_id"], batch["grams"], strict=True):
                g = np.unique(np.frombuffer(grams, np.int64), return_index=True)
                yield pd.DataFrame({"item_id": item_id, "gram": g[0], "at": g[1].astype(np.int32)})

    return items.select("item_id", "grams").mapInPandas(unpack, "item_id long, gram long, at int"), items.select("item_id", "item")


def seed_hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, gram, pos (word index) of every place in ``docs`` whose n-gram may be a seed."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(seeds.select(F.col("gram").alias("key"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy().astype(np.int64)
            found = []
            for k, s in enumerate(shingles(*words(_lower(batch["text"]), PUNCTUATION), SEED)):
                pos = np.flatnonzero(in_bitmap(known.value, s.view(np.int64)))
                if len(pos):
                    found.append((np.full(len(pos), ids[k]), s[pos].view(np.int64), pos))
            if found:
                yield pd.DataFrame({c: np.concatenate([f[j] for f in found]) for j, c in enumerate(("doc_id", "gram", "pos"))})

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(run, "doc_id long, gram long, pos long")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word-hash arrays, and where in the passage it ends.

    One numpy row per item word: with a linear gap cost the run along the row is a running maximum.
    """
    slope = np.arange(len(passage) + 1) * -GAP
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        new = np.zeros_like(row)
        np.maximum(row[:-1] + step, row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (1 for a whole copy), start_word, end_word of every contaminated document and item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("own_id"), "text").distinct()
    texts = materialise(texts.withColumn("item_id", F.xxhash64("own_id", "text")), "item-texts")  # a key for each text of an item
    seeds, items = item_seeds(texts.select("item_id", "text"))
    items = items.join(texts.select("item_id", "own_id"), "item_id")
    hits = materialise(seed_hits(docs, seeds), "hits")
    spread = hits.select("doc_id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    rank = W.partitionBy("item_id")  # one item's seeds: as many as its words
    rare = (
        seeds.join(spread, "gram", "left").fillna(0, ["df"])
        .withColumn("r", F.row_number().over(rank.orderBy("df", "gram"))).withColumn("n", F.count("*").over(rank))
        .filter(F.col("r") <= F.ceil(F.col("n") * RARE)).select("gram", "item_id", "at")
    )
    # A place nominates the diagonal on which the item would start; near diagonals are one stretch.
    near = hits.join(rare, "gram").select("doc_id", "item_id", F.floor((F.col("pos") - F.col("at")) / 8).alias("diagonal")).distinct()
    per_item = near.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    wanted = materialise(
        per_item.join(items, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("own_id", "diagonals", "item")).alias("items")), "wanted")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("doc_id").alias("key"))))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[in_bitmap(known.value, batch["doc_id"].to_numpy().astype(np.int64))]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, bounds = words(_lower(batch["text"]), PUNCTUATION)
            rows = []
            for doc_id, items_, a, b in zip(batch["doc_id"], batch["items"], bounds[:-1], bounds[1:], strict=True):
                doc, passed = h[a:b], {}
                for x in items_:
                    item = np.frombuffer(x["item"], np.uint64)
                    n, best = len(item), (0, 0, 0)
                    stretches: list[list[int]] = []
                    for d in x["diagonals"]:
                        lo, hi = int(d) * 8 - n // 2, int(d) * 8 + 8 + n + n // 2
                        if stretches and lo <= stretches[-1][1]:
                            stretches[-1][1] = hi
                        else:
                            stretches.append([lo, hi])
                    for lo, hi in stretches:
                        lo = max(lo, 0)
                        got, end = align(item, doc[lo:hi])
                        best = max(best, (got, -lo, end))
                    got, lo, end = best[0], -best[1], best[2]
                    if got >= threshold * MATCH * n:
                        back = align(item[::-1], doc[lo : lo + end][::-1])[1]
                        found = (got / (MATCH * n), back - lo - end, lo + end)
                        passed[x["own_id"]] = max(passed.get(x["own_id"], found), found)
                rows += [(doc_id, own, share, -first, end) for own, (share, first, end) in sorted(passed.items())]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start_word", "end_word"])

    chosen = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(pick, "doc_id long, text string")
    found = chosen.join(wanted, "doc_id").select("doc_id", "text", "items").mapInPandas(
        score, "doc_id long, item_id long, score double, start_word long, end_word long")
    return found.withColumn("score", F.round("score", 6))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the contaminated documents, each row being one, also where its doc_id is repeated or null; columns of any name pass."""
    own, _ = keyed(docs)
    # Written first: its size is then known, and Spark broadcasts it only below its threshold.
    bad = materialise(contaminated(own.select(F.col("key").alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return own.join(bad, "key", "left_anti").select("src.*")
