"""Exact vector search as column expressions, and approximate search with trained quantisers and graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.lexical import top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def knn(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10, metric: str = "ip") -> DataFrame:
    """Exact top k of a bounded query block against all vectors: qid, vec_id, rank, score.

    Each partition multiplies its rows with the query block and keeps its own top k of every query; the window then
    merges them. Rows that leave a partition: queries * k, however large it is. Larger query sets go in blocks.
    """
    ids = np.array([q for q, _ in queries], np.int64)
    block = np.array([v for _, v in queries], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        best: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch) or not len(qids):
                continue
            x = _matrix(batch["embedding"])
            s = q @ x.T if metric == "ip" else -((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
            part = pd.DataFrame({"qid": np.repeat(qids, x.shape[0]), "vec_id": np.tile(batch["vec_id"].to_numpy(), len(qids)), "score": np.round(s, 6).ravel()})
            best = [pd.concat([*best, part]).sort_values(["qid", "score", "vec_id"], ascending=[True, False, True]).groupby("qid").head(k)]
        yield from best

    partial = vectors.select("vec_id", "embedding").mapInPandas(run, "qid long, vec_id long, score double")
    return top_k(partial, k, item="vec_id").select("qid", "vec_id", "rank", "score")


def medoid(vectors: DataFrame) -> DataFrame:
    """vec_id and squared distance of the vector nearest the mean, ties to the lower id."""
    mean = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    far = (
        vectors.select("vec_id", F.posexplode("embedding").alias("i", "x")).join(F.broadcast(mean), "i")  # one row a dimension
        .groupBy("vec_id").agg(F.round(F.sum((F.col("x").cast("double") - F.col("m")) * (F.col("x").cast("double") - F.col("m"))), 6).alias("distance"))
    )
    return far.orderBy("distance", "vec_id").limit(1)


def _rows_for_training(vectors: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most ``most`` vectors, the smallest by a seeded hash of the id: the same ones every time."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(most).select("embedding").toPandas()
    return _matrix(rows["embedding"])


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means with random starts and farthest-point reseeding of empty clusters; deterministic."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        label = d.argmin(1)
        near = d[np.arange(len(x)), label].copy()
        for c in range(k):
            own = label == c
            if own.any():
                centres[c] = x[own].mean(0)
            else:
                far = int(near.argmax())
                centres[c], near[far] = x[far], -1
    return centres


def kmeans(vectors: DataFrame, k: int, most: int = 50_000, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres fitted on a bounded sample, for use on every row."""
    return lloyd(_rows_for_training(vectors, most, seed), k, rounds, seed)


def assign(vectors: DataFrame, centres: np.ndarray, overlap: int = 1) -> DataFrame:
    """vec_id, embedding, cluster of the ``overlap`` nearest centres of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["embedding"])
            near = np.argsort((c * c).sum(1) - 2 * x @ c.T, axis=1, kind="stable")[:, :overlap]
            yield pd.DataFrame({"vec_id": np.repeat(batch["vec_id"].to_numpy(), near.shape[1]),
                                "embedding": [v for v in batch["embedding"] for _ in range(near.shape[1])], "cluster": near.ravel()})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, embedding array<float>, cluster long")


class ProductQuantiser:
    """``parts`` sub-quantisers of ``size`` centroids on centred data; widths differ by one where the dimensions do not divide evenly."""

    def __init__(self, x: np.ndarray, parts: int = 8, size: int = 64, seed: int = 0):
        self.mean = x.mean(0)
        ends = np.arange(parts + 1) * x.shape[1] // parts
        self.parts, self.cuts = parts, [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        centred = x - self.mean
        self.books = [lloyd(centred[:, cut], size, seed=seed + m) for m, cut in enumerate(self.cuts)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        centred = x - self.mean
        out = np.empty((len(x), self.parts), np.uint8)
        for m, book in enumerate(self.books):
            part = centred[:, self.cuts[m]]
            out[:, m] = ((book * book).sum(1) - 2 * part @ book.T).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([book[codes[:, m]] for m, book in enumerate(self.books)]) + self.mean

    def inner_products(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from a table of one row a part."""
        table = [book @ query[cut] for book, cut in zip(self.books, self.cuts, strict=True)]
        return sum(t[codes[:, m]] for m, t in enumerate(table)) + float(query @ self.mean)


def ivf_pq(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10, lists: int = 16, probes: int = 8, refine: int = 10, seed: int = 0) -> DataFrame:
    """Inverted lists with product-quantised codes, exact re-ranking of the best ``refine * k`` of each partition.

    Quantisers are fitted on a bounded sample; every row is encoded, assigned and searched.
    """
    sample = _rows_for_training(vectors, 50_000, seed)
    centres, pq = lloyd(sample, lists, seed=seed), ProductQuantiser(sample, seed=seed)
    shared = vectors.sparkSession.sparkContext.broadcast((centres, pq, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, quantiser, asked = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x, ids, lists_ = _matrix(batch["embedding"]), batch["vec_id"].to_numpy(), batch["cluster"].to_numpy()
            codes, out = quantiser.encode(x), []
            for qid, v in asked:
                q = np.asarray(v, np.float64)
                probed = np.argsort((c * c).sum(1) - 2 * c @ q, kind="stable")[:probes]
                rows = np.flatnonzero(np.isin(lists_, probed))
                rough = quantiser.inner_products(q, codes[rows])
                rows = rows[np.argsort(-rough, kind="stable")[: refine * k]]
                exact = np.round(x[rows] @ q, 6)
                best = np.lexsort((ids[rows], -exact))[:k]
                out.append(pd.DataFrame({"qid": qid, "vec_id": ids[rows][best], "score": exact[best]}))
            yield pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "score": []})

    partial = assign(vectors, centres).mapInPandas(run, "qid long, vec_id long, score double")
    return top_k(partial, k, item="vec_id").select("qid", "vec_id", "rank", "score")


def _prune(p: int, candidates: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keep the nearest candidate, drop those it covers within ``alpha``, repeat."""
    candidates = np.unique(candidates[candidates != p])
    d = ((x[candidates] - x[p]) ** 2).sum(1)
    candidates = candidates[np.lexsort((candidates, d))]
    d = np.sort(d)
    kept: list[int] = []
    while len(candidates) and len(kept) < degree:
        c = candidates[0]
        kept.append(int(c))
        open_ = alpha * alpha * ((x[candidates] - x[c]) ** 2).sum(1) > d
        open_[0] = False
        candidates, d = candidates[open_], d[open_]
    return np.array(kept, np.int64)


def _greedy(x: np.ndarray, graph: list[np.ndarray], start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search with a list of ``width``: (list by distance, expanded nodes)."""
    seen, expanded = {start}, []
    pool = [(float(((x[start] - q) ** 2).sum()), start)]
    done: set[int] = set()
    while True:
        todo = next((n for _, n in pool if n not in done), None)
        if todo is None:
            return np.array([n for _, n in pool]), np.array(expanded, np.int64)
        done.add(todo)
        expanded.append(todo)
        fresh = np.array([n for n in graph[todo] if n not in seen], np.int64)
        if len(fresh):
            seen.update(fresh.tolist())
            pool += list(zip(((x[fresh] - q) ** 2).sum(1).tolist(), fresh.tolist(), strict=True))
            pool = sorted(pool)[:width]


def build_graph(x: np.ndarray, degree: int = 16, width: int = 32, alpha: float = 1.2, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """A navigable proximity graph: random regular start, two pruning passes, medoid as entry."""
    rng, n = np.random.default_rng(seed), len(x)
    graph = [rng.choice(n, min(degree, n - 1), replace=False) if n > 1 else np.zeros(0, np.int64) for _ in range(n)]
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    for a in (1.0, alpha):
        for p in rng.permutation(n):
            _, visited = _greedy(x, graph, entry, x[p], width)
            graph[p] = _prune(p, np.concatenate((visited, graph[p])), x, degree, a)
            for j in graph[p]:
                if p not in graph[j]:
                    merged = np.append(graph[j], p)
                    graph[j] = _prune(int(j), merged, x, degree, a) if len(merged) > degree else merged
    return graph, entry


def reachable(graph: list[np.ndarray], entry: int) -> int:
    """Nodes that a walk from the entry can reach."""
    seen, edge = {entry}, [entry]
    while edge:
        edge = [int(j) for i in edge for j in graph[i] if j not in seen and not seen.add(int(j))]
    return len(seen)


def graph_search(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10, clusters: int = 4, overlap: int = 2, width: int = 64,
                 most: int = 20_000, seed: int = 0) -> DataFrame:
    """Partitioned graph index: every vector joins its ``overlap`` nearest clusters, each cluster builds a graph and answers.

    Clusters are kept below about ``most`` vectors by adding clusters with the input, so a build's memory is bounded.
    """
    n = vectors.count()
    centres = kmeans(vectors, max(clusters, -(-n * overlap // most)), seed=seed)
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x, ids = _matrix(group["embedding"]), group["vec_id"].to_numpy()
        graph, entry = build_graph(x, seed=seed)
        out = []
        for qid, v in shared.value:
            q = np.asarray(v, np.float64)
            found, _ = _greedy(x, graph, entry, q, width)
            s = np.round(x[found] @ q, 6)
            best = np.lexsort((ids[found], -s))[:k]
            out.append(pd.DataFrame({"qid": qid, "vec_id": ids[found][best], "score": s[best]}))
        return pd.concat(out)

    found = assign(vectors, centres, overlap).groupBy("cluster").applyInPandas(run, "qid long, vec_id long, score double")
    return top_k(found.groupBy("qid", "vec_id").agg(F.max("score").alias("score")), k, item="vec_id").select("qid", "vec_id", "rank", "score")


def recall_at_k(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """qid and the share of the true top k that was found."""
    hit = truth.filter(F.col("rank") <= k).join(found.filter(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return hit.groupBy("qid").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.lit(float(k)), 6).alias("recall"))


def query_blocks(queries: DataFrame, column: str = "vec_id", size: int = 2048) -> Iterator[list[tuple[int, list[float]]]]:
    """The query vectors in blocks of ``size``, streamed to the driver one block at a time."""
    block: list[tuple[int, list[float]]] = []
    for row in queries.select(column, "embedding").orderBy(column).toLocalIterator():
        block.append((row[0], list(row[1])))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def in_blocks(queries: DataFrame, search) -> DataFrame:
    """``search(block)`` for every block of a stated query set, all results together."""
    found = None
    for block in query_blocks(queries):
        part = search(block)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else search([])


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip") -> DataFrame:
    """Exact top k of every row of ``queries`` against all vectors, in blocks."""
    return in_blocks(queries, lambda block: knn(vectors, block, k, metric))


def merge_slices(slices: DataFrame, k: int) -> DataFrame:
    """Top k of rows (qid, vec_id, score) from several slices; a repeated id keeps its best score."""
    best = slices.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
