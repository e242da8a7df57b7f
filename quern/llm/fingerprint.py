"""Document fingerprints: MinHash signatures, banded and verified.

A fingerprint is ``SIZE`` universal hash permutations' minima over five-word shingles, 16 bits kept of each,
written as hex. The likeness of two fingerprints is the share of equal minima, corrected for chance.
``near_classes`` posts every signature under ``SIZE / ROWS`` bands, joins the bands in Spark and verifies the
candidates' Jaccard similarity on full sets; ``edited_fingerprints`` compares each text with an edited copy
of itself and with its successor by doc_id.

The successor is found without a global sort in one task: documents are dealt to ranges of doc_id, each
range's first document is dealt to the range before as well, and a range streams through in order.

Defined cases: null text is empty; empty texts have one common fingerprint; documents without doc_id come
after all others; rows that repeat a doc_id follow each other ordered by text; one document alone follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.storage import materialise
from quern.llm.components import connected_components
from quern.llm.near import confirm
from quern.llm.wordhash import MinHash, shingles, words

SIZE, ROWS, SHINGLE = 128, 4, 5
MOST_RANGES = 4096


def signatures(texts: list[str]) -> np.ndarray:
    """One row of SIZE 16-bit minima a text."""
    sign = MinHash(SIZE)
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    rows = [(sign(s) >> np.uint32(16)).astype(">u2") for s in shingles(*words(encoded), SHINGLE)]
    return np.array(rows, dtype=">u2").reshape(len(texts), SIZE)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of signatures; 1 for equal ones."""
    chance = 2.0**-16
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0.0, 1.0)


def _range_of(column, splits: list[int], low: int = 0):
    """The number of splits at or below the column, as a balanced tree of comparisons."""
    if not splits:
        return F.lit(low)
    mid = len(splits) // 2
    return F.when(column < F.lit(splits[mid]), _range_of(column, splits[:mid], low)).otherwise(
        _range_of(column, splits[mid + 1 :], low + mid + 1))


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``range`` and ``tail``; a range ends with the first rows of the next as its tail."""
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    cuts = docs.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_range_of(F.col("doc_id"), sorted({int(c) for c in cuts})))
    placed = docs.withColumn("range", place)
    heads = [(r["range"], r["head"]) for r in placed.groupBy("range").agg(F.min("doc_id").alias("head")).orderBy("range").collect()]  # one a range
    if not heads:
        return placed.withColumn("tail", F.lit(0))
    firsts = docs.sparkSession.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "head long, before int")
    joined = placed.join(F.broadcast(firsts), placed["doc_id"].eqNullSafe(firsts["head"]), "left")  # at most MOST_RANGES + 1 rows
    both = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("range"), F.lit(1).alias("tail")))
    return joined.select("doc_id", "text", F.explode(both).alias("at")).select("doc_id", "text", "at.range", "at.tail").filter("range IS NOT NULL")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter replaced by as much of the successor's beginning.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_ranges(docs).repartition(parts, "range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_last(), "text")
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def emit(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        ids, texts, following = zip(*pairs, strict=True)
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following, strict=True)]
        own, changed = signatures([*texts, following[-1]]), signatures(edited)
        # A pair's successor is mostly the next pair's own text.
        chained = all(following[k] is texts[k + 1] for k in range(len(texts) - 1))
        after = own[1:] if chained else signatures(list(following))
        own = own[:-1]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array([s.tobytes().hex() for s in own]), pa.array([s.tobytes().hex() for s in changed]),
            pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pairs, size = None, [], 0  # last: (range, doc_id, text) whose successor is to come
        for batch in batches:
            for doc_id, text, place, tail in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last is not None and last[0] == place:
                    pairs.append((last[1], last[2], text))
                    size += len(last[2])
                last = None if tail else (place, doc_id, text)
                if size > 1 << 20 or len(pairs) >= 2000:
                    yield emit(pairs)
                    pairs, size = [], 0
        if pairs:
            yield emit(pairs)

    return dealt.mapInArrow(run, schema)


def near_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """id and component_id of the documents that have a near copy: bands joined in Spark, Jaccard verified."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k, t in enumerate(batch.column(1).to_pylist()) if t]
            sig = signatures([batch.column(1)[k].as_py() for k in keep])
            bands = np.ascontiguousarray(sig).view(">u8").astype(np.int64).reshape(len(keep), SIZE // ROWS)
            tags = bands * 64 + np.arange(SIZE // ROWS)
            ids = np.repeat(batch.column(0).take(pa.array(keep, pa.int64())).to_numpy(zero_copy_only=False), SIZE // ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(tags.ravel()), pa.array(ids.astype(np.int64))], names=["band", "id"])

    posts = materialise(docs.filter("doc_id IS NOT NULL AND text <> ''").mapInArrow(run, "band long, id long"), "bands")
    # First every member of a band is held against its smallest id, then members of different components against each other.
    heads = posts.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    pairs = materialise(posts.join(heads, "band").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "band-pairs")
    links = materialise(confirm(docs, pairs, SHINGLE, percent), "band-links")
    first = connected_components(links)
    label = materialise(
        posts.join(first, "id", "left").select("band", "id", F.coalesce("component_id", "id").alias("comp")), "band-labels")
    open_bands = label.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    rest = label.join(open_bands, "band", "left_semi")
    one = rest.select("band", F.col("id").alias("a"), F.col("comp").alias("ca"))
    two = rest.select("band", F.col("id").alias("b"), F.col("comp").alias("cb"))
    cross = one.join(two, "band").filter("a < b AND ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialise(confirm(docs, materialise(cross, "band-pairs"), SHINGLE, percent), "band-links")
    return connected_components(links.unionByName(more))
