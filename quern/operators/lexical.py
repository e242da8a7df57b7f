"""BM25 over an inverted index kept as ordinary tables.

Postings are (term, doc_id, tf, dl, block), a block being ``BLOCK`` consecutive doc_ids; document statistics (doc_id, dl);
term statistics (term, df, cf, max_tf, min_dl); block bounds (term, block, n, max_tf, min_dl); collection statistics one
row. A stored index is sharded by document and sorted by term, so a query's terms select row groups and scores are summed
without a shuffle; every function takes an index or a corpus (doc_id, text), which is then analysed on the fly. A query set is (qid, term, boost). The top k is kept with a
ranked window that Spark prunes before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.storage import checkpoint_root, materialise
from quern.functions.text import simple_tokens

K1, B = 0.9, 0.4
BLOCK, PROBED, PUSHED_TERMS = 64, 8, 10_000


@dataclass
class Index:
    """An inverted index: postings, docs, terms, bounds as frames and the collection's n_docs and sum_dl."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    bounds: DataFrame
    n_docs: int
    sum_dl: int

    @property
    def avgdl(self) -> float:
        return self.sum_dl / self.n_docs if self.n_docs else 1.0


def spread(corpus: DataFrame) -> DataFrame:
    """``corpus``, dealt to all cores where it comes in fewer parts than there are cores."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return corpus.repartition(cores) if corpus.rdd.getNumPartitions() < cores else corpus


def index_tables(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings and docs of a corpus."""
    docs = analysed(corpus).withColumn("dl", F.size("tokens").cast("long")).withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    posts = docs.select("doc_id", "dl", "block", F.explode("tokens").alias("term")).groupBy("doc_id", "term", "dl", "block").agg(F.count("*").alias("tf"))
    return posts.select("term", "doc_id", "tf", "dl", "block"), docs.select("doc_id", "dl")


def _index(posts: DataFrame, docs: DataFrame, keep) -> Index:
    extremes = (F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    bounds = keep(posts.groupBy("term", "block").agg(F.count("*").alias("n"), F.sum("tf").alias("cf"), *extremes), "bounds")
    terms = keep(bounds.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")), "terms")
    row = collection_stats(docs).first()
    return Index(posts, docs, terms, bounds, row["n_docs"], row["sum_dl"])


def store_index(corpus: DataFrame, name: str, shards: int | None = None) -> Index:
    """Build an index once, as tables ``name_*`` under the shared folder.

    Postings are bucketed by document and sorted by term: a document's score is summed where its postings are read,
    without a shuffle, and a query's terms select row groups of every shard.
    """
    spark = corpus.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts, docs = index_tables(spread(corpus))

    def keep(df: DataFrame, part: str) -> DataFrame:
        key, order = ("doc_id", [c for c in ("term", "doc_id") if c in df.columns]) if part in ("postings", "docs") else ("term", ["term"])
        df.repartition(shards, key).write.mode("overwrite").option("compression", "zstd").option("path", f"{checkpoint_root(spark)}/{name}-{part}").bucketBy(
            shards, key).sortBy(*order).saveAsTable(f"{name}_{part}")
        return spark.table(f"{name}_{part}")

    return _index(keep(posts, "postings"), keep(docs, "docs"), keep)


def read_index(spark: SparkSession, name: str) -> Index:
    """The index that :func:`store_index` stored as tables ``name_*``."""
    posts, docs, terms, bounds = (spark.table(f"{name}_{part}") for part in ("postings", "docs", "terms", "bounds"))
    row = collection_stats(docs).first()
    return Index(posts, docs, terms, bounds, row["n_docs"], row["sum_dl"])


def as_index(corpus: DataFrame | Index) -> Index:
    return corpus if isinstance(corpus, Index) else _index(*index_tables(corpus), lambda df, _: df)


def of_terms(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of an index table whose term is in ``terms``; few terms are pushed down to its files."""
    known = [r[0] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(known) <= PUSHED_TERMS:
        return table.filter(F.col("term").isin(known))
    return table.join(terms.select("term").distinct(), "term", "left_semi")


def analysed(corpus: DataFrame) -> DataFrame:
    """doc_id and its tokens, of every document with at least one."""
    return corpus.select("doc_id", simple_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)


def postings(corpus: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return analysed(corpus).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lexicon(posts: DataFrame) -> DataFrame:
    """term, df, cf."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(corpus: DataFrame) -> DataFrame:
    return analysed(corpus).select("doc_id", F.size("tokens").cast("long").alias("dl"))


def collection_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, sum_dl, avgdl."""
    return stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl"),
                     (F.sum("dl") / F.count("*")).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, boost (times it occurs), pos (first occurrence) of queries (qid, text)."""
    tokens = queries.select("qid", F.posexplode(simple_tokens(F.col("text"))).alias("pos", "term"))
    return tokens.groupBy("qid", "term").agg(F.count("*").alias("boost"), F.min("pos").alias("pos"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def contribution(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """weight * tf / (tf + k1 (1 - b + b dl / avgdl)), in the form w - w / (1 + tf inv)."""
    inverse = F.lit(1.0) / (F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))
    return weight - weight / (F.lit(1.0) + tf * inverse)


def weighted_terms(index: Index, queries: DataFrame, k1: float = K1, model: str = "textbook") -> DataFrame:
    """qid, term, pos, df, weight of every query term that the index knows; written, so that Spark knows its size and broadcasts it only if small."""
    terms = query_terms(queries)
    known = terms.join(of_terms(index.terms, terms), "term")
    weight = F.col("boost") * idf(F.lit(index.n_docs), F.col("df")) * (k1 + 1.0 if model == "textbook" else 1.0)
    return materialise(known.select("qid", "term", "pos", "df", weight.alias("weight")), "query-terms")


def term_scores(corpus: DataFrame | Index, queries: DataFrame, k1: float = K1, b: float = B, model: str = "textbook") -> DataFrame:
    """qid, doc_id, term, pos, tf, df, score: one row for each query term that a document holds; df and the collection statistics cover all documents."""
    index = as_index(corpus)
    terms = weighted_terms(index, queries, k1, model)
    rows = of_terms(index.postings, terms).join(terms, "term")
    return rows.select("qid", "doc_id", "term", "pos", "tf", "df",
                       contribution(F.col("weight"), F.col("tf"), F.col("dl"), F.lit(index.avgdl), k1, b).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "qid", item: str = "doc_id") -> DataFrame:
    """Rank by score descending, then item ascending, and keep k; k = 0 keeps none."""
    order = W.partitionBy(key).orderBy(F.desc("score"), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(corpus: DataFrame | Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, model: str = "textbook") -> DataFrame:
    """qid, doc_id, rank, score (rounded to 6 places; ranks follow the rounded score)."""
    scores = term_scores(corpus, queries, k1, b, model).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return top_k(scores, k).select("qid", "doc_id", "rank", "score")


def explain(corpus: DataFrame | Index, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
    """The term contributions behind each ranked document, with each term's share of the score."""
    terms = term_scores(corpus, queries, **kw)
    best = top_k(terms.groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")), k).select("qid", "doc_id", "rank", F.col("score").alias("total"))
    return terms.join(best, ["qid", "doc_id"]).select(
        "qid", "doc_id", "rank", "term", "tf", "df", F.round("score", 6).alias("score"), F.round(F.col("score") / F.col("total"), 4).alias("share"))


def term_bounds(corpus: DataFrame | Index, k1: float = K1, b: float = B) -> DataFrame:
    """Score upper bounds of each term: largest tf, smallest dl, and the largest tf * inverse norm."""
    index = as_index(corpus)
    gain = F.col("tf") / (F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl)))
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.round(F.max(gain), 6).alias("max_gain"))


def block_bounds(corpus: DataFrame | Index, queries: DataFrame, k1: float = K1, b: float = B, model: str = "textbook") -> DataFrame:
    """qid, block, bound, n: no document of the block scores above the bound; n is the postings of the query in it.

    A term's bound in a block takes its largest tf and smallest dl there, which holds for any k1 and b.
    """
    index = as_index(corpus)
    terms = weighted_terms(index, queries, k1, model)
    most = contribution(F.col("weight"), F.col("max_tf"), F.col("min_dl"), F.lit(index.avgdl), k1, b)
    rows = of_terms(index.bounds, terms).drop("cf").join(terms.select("qid", "term", "weight"), "term")
    return rows.groupBy("qid", "block").agg(F.sum(most).alias("bound"), F.sum("n").alias("n"))


def _in_blocks(index: Index, queries: DataFrame, blocks: DataFrame, k1: float, b: float, model: str) -> DataFrame:
    """Exact scores of the documents in the query's blocks (qid, block)."""
    terms = weighted_terms(index, queries, k1, model).select("qid", "term", "weight")
    rows = of_terms(index.postings, terms).join(terms, "term").join(blocks, ["qid", "block"], "left_semi")
    score = contribution(F.col("weight"), F.col("tf"), F.col("dl"), F.lit(index.avgdl), k1, b)
    return rows.groupBy("qid", "doc_id").agg(F.sum(score).alias("score"))


def surviving_blocks(corpus: DataFrame | Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, model: str = "textbook") -> DataFrame:
    """qid, block, bound, n, kept: the blocks whose bound reaches the k-th best score of the query's ``PROBED`` best bounded blocks.

    That score is a lower bound of the true k-th best, so a document of the top k is never in a block that is not kept.
    """
    index = as_index(corpus)
    bounds = materialise(block_bounds(index, queries, k1, b, model), "query-bounds")
    best = W.partitionBy("qid").orderBy(F.desc("bound"), "block")
    probed = bounds.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PROBED).select("qid", "block")
    theta = top_k(_in_blocks(index, queries, probed, k1, b, model), k).filter(F.col("rank") == k).select("qid", F.col("score").alias("theta"))
    # Scores are ranked as rounded to 6 places.
    return bounds.join(theta, "qid", "left").select("qid", "block", "bound", "n", F.coalesce(F.col("bound") >= F.col("theta") - 1e-5, F.lit(True)).alias("kept"))


def pruned(corpus: DataFrame | Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, model: str = "textbook") -> DataFrame:
    """The same top k as :func:`bm25`, scoring only postings of the blocks whose bound can reach it."""
    index = as_index(corpus)
    kept = materialise(surviving_blocks(index, queries, k, k1, b, model).filter("kept").select("qid", "block"), "query-blocks")
    scores = _in_blocks(index, queries, kept, k1, b, model).select("qid", "doc_id", F.round("score", 6).alias("score"))
    return top_k(scores, k).select("qid", "doc_id", "rank", "score")


def pruning_report(corpus: DataFrame | Index, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
    """qid, blocks, blocks_kept, postings, postings_kept: what an exhaustive and a pruned search score."""
    rows = surviving_blocks(corpus, queries, k, **kw)
    kept = F.when(F.col("kept"), F.col("n")).otherwise(0)
    return rows.groupBy("qid").agg(F.count("*").alias("blocks"), F.count_if("kept").alias("blocks_kept"), F.sum("n").alias("postings"), F.sum(kept).alias("postings_kept"))


def selected(corpus: DataFrame | Index, queries: DataFrame, candidates: DataFrame, **kw) -> DataFrame:
    """qid, doc_id, score of given candidates (qid, doc_id); those without a query term score 0."""
    scores = term_scores(corpus, queries, **kw).join(candidates.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    total = scores.groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return candidates.select("qid", "doc_id").distinct().join(total, ["qid", "doc_id"], "left").fillna(0.0, ["score"])
