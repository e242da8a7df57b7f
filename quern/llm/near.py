"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and a signature of ``SIZE``
   universal hash permutations. Equal sets collapse to one representative, the smallest doc_id.
2. Representatives are posted under coordinate-value pairs. Two sets at the threshold agree in at least
   ``MATCHES`` of ``SIZE`` coordinates (but for 4 pairs in 100,000 at exactly 0.8, fewer above), so they
   share one of any SIZE-MATCHES+1 pairs: each set is posted only under that many of its rarest pairs
   (prefix), and the long lists of common pairs are never merged (skip). Rarity comes from a count
   sketch of fixed size over all signatures, which gives all sets the same order at any input size.
3. Lists are merged without emitting all pairs: each member is held against its list's smallest member,
   the links that hold on full sets are joined into components, and lists whose members are now all in
   one component are done.
4. In the remaining lists every pair from different components is counted with numpy inside the list
   (long lists in pairs of blocks); pairs with enough matching coordinates, each reported by one list
   only, are confirmed on full sets and joined in. Against a component of more than ``LARGE`` members a
   document is reported once and held against all members, both sides in blocks of whole sets. No list,
   partner or candidate is capped.

Sets are recomputed from the source text for candidates only, selected by a bitmap of fixed size.

Defined cases: null or empty text has the empty set and links with nothing (so is its own component);
fewer words than the shingle size make one shingle of the whole sequence; repeated doc_ids count as one
document each and share the component; a null doc_id is kept and stays alone, with null component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.storage import materialise, release
from quern.llm.components import connected_components
from quern.llm.grid import add_up, bitmap, in_bitmap
from quern.llm.rows import keyed
from quern.llm.wordhash import MinHash, shingles, words

SIZE, MATCHES = 64, 38
PREFIX = SIZE - MATCHES + 1
CELL_BITS = 18  # of the count sketch
LIST_BLOCK = 2048
LARGE, SET_BLOCK = 64, 128
_WEIGHT = np.uint64(1) << np.arange(SIZE, dtype=np.uint64)


def _texts(batch: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in batch["text"]]


def _signed(low: int) -> int:
    return low - (1 << 64) if low >> 63 else low


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (128-bit digest of the set), sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = MinHash(SIZE)
        for batch in batches:
            rows = []
            for s in shingles(*words(_texts(batch)), k):
                s = np.unique(s)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((len(s), _signed(d & (2**64 - 1)), _signed(d >> 64), sign(s).tobytes()))
            yield pd.DataFrame(rows, columns=["n_shingles", "d1", "d2", "sig"]).assign(doc_id=batch["doc_id"].array)[
                ["doc_id", "n_shingles", "d1", "d2", "sig"]]

    # Ids travel as strings: pandas would turn a nullable long into a double.
    signed = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, n_shingles long, d1 long, d2 long, sig binary")
    return signed.withColumn("doc_id", F.col("doc_id").cast("long"))


def _tokens(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each coordinate-value pair."""
    t = sigs.astype(np.uint64) | (np.arange(SIZE, dtype=np.uint64)[None, :] << np.uint64(32))
    t *= np.uint64(0x9E3779B97F4A7C15)
    t ^= t >> np.uint64(29)
    t *= np.uint64(0xBF58476D1CE4E5B9)
    t ^= t >> np.uint64(32)
    return t


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), SIZE)


def rarity(reps: DataFrame) -> np.ndarray:
    """Counts of all coordinate-value pairs in a sketch of 2**CELL_BITS cells."""

    def cells(total, batch):
        t = _tokens(_matrix(batch["sig"])).ravel()
        total += np.bincount((t >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total)).astype(total.dtype)

    return add_up(reps.select("sig"), cells, 1 << CELL_BITS, "int64")


def postings(reps: DataFrame, counts: np.ndarray) -> DataFrame:
    """token, id, for the PREFIX rarest coordinate-value pairs of every set."""
    shared = reps.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t = _tokens(_matrix(batch["sig"]))
            order = np.lexsort((t, shared.value[(t >> np.uint64(64 - CELL_BITS)).astype(np.int64)]), axis=1)[:, :PREFIX]
            mask = (np.uint64(1) << order.astype(np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({
                "token": np.take_along_axis(t, order, axis=1).view(np.int64).ravel(), "coordinate": order.astype(np.int32).ravel(),
                "id": np.repeat(batch["id"].to_numpy(), PREFIX), "mask": np.repeat(mask, PREFIX)})

    return reps.select("id", "sig").mapInPandas(run, "token long, coordinate int, id long, mask long")


def alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs that have enough matching coordinates and set sizes within the threshold's ratio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m, n = batch["m"].to_numpy(), batch["n"].to_numpy()
            ok = (_matrix(batch["x"]) == _matrix(batch["y"])).sum(axis=1) >= MATCHES
            yield batch.loc[ok & (np.minimum(m, n) * 100 >= np.maximum(m, n) * percent), ["a", "b"]]

    left = reps.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("sig").alias("x"))
    right = reps.select(F.col("id").alias("b"), "n", F.col("sig").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "m", "n", "x", "y").mapInPandas(run, "a long, b long")


def _packed(s: np.ndarray) -> bytes:
    """A sorted set of 64-bit hashes as 5 bytes each: their upper 40 bits."""
    return np.ascontiguousarray((s >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and whole shingle set of the documents whose id is in ``ids`` (key), computed where the text is read."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[in_bitmap(wanted.value, batch["doc_id"].to_numpy().astype(np.int64))]
            for k0 in range(0, len(batch), 256):
                part = batch.iloc[k0 : k0 + 256]
                found = [_packed(np.unique(s)) for s in shingles(*words(_texts(part)), k)]
                yield pd.DataFrame({"id": part["doc_id"].to_numpy().astype(np.int64), "shingles": found})

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, "id long, shingles binary")


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids with 100 * |intersection| >= percent * |union|, on full sets."""
    left, right = (full_sets(docs, pairs.select(F.col(c).alias("key")), k).select(F.col("id").alias(c), F.col("shingles").alias(s))
                   for c, s in (("a", "x"), ("b", "y")))

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                both = np.concatenate((_unpacked(x), _unpacked(y)))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.loc[keep, ["a", "b"]]

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return joined.mapInPandas(hold, "a long, b long").distinct()


def _cross(part: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one list from different components with enough matching coordinates and alike set sizes.

    Where the larger of the two components has more than LARGE members, (document, component) stands for all such
    pairs and is flagged as a probe.
    """
    ids, comp, size, block = part["id"], part["comp"], part["n"], part["block"]
    mask, sig = part["mask"].view(np.uint64), part["sig"]
    bit, apart = np.uint64(1) << np.uint64(part["coordinate"][0]), part["bi"][0] != part["bj"][0]
    members = part["members"]
    left, right, probe = [], [], []
    for p in range(len(ids) - 1):
        rest = slice(p + 1, None)
        ok = (comp[rest] != comp[p]) & (np.minimum(size[rest], size[p]) * 100 >= np.maximum(size[rest], size[p]) * percent)
        if apart:
            ok &= block[rest] != block[p]
        q = np.flatnonzero(ok) + p + 1
        if not len(q):
            continue
        same = sig[q] == sig[p]
        enough = same.sum(axis=1) >= MATCHES
        if enough.any():
            q, same = q[enough], same[enough]
            shared = (same * _WEIGHT).sum(axis=1, dtype=np.uint64) & mask[q] & mask[p]
            q = q[shared & (~shared + np.uint64(1)) == bit]  # reported by the first shared list only
            to_p = (members[p] > members[q]) | ((members[p] == members[q]) & (comp[p] < comp[q]))
            large = np.where(to_p, members[p], members[q]) > LARGE
            left += [np.full((~large).sum(), ids[p]), np.where(to_p, ids[q], ids[p])[large]]
            right += [ids[q[~large]], np.where(to_p, comp[p], comp[q])[large]]
            probe += [np.zeros((~large).sum(), bool), np.ones(large.sum(), bool)]
    none = np.zeros(0, np.int64)
    if not left:
        return none, none, none.astype(bool)
    found = np.unique(np.column_stack((np.concatenate(left), np.concatenate(right), np.concatenate(probe))), axis=0)
    return found[:, 0], found[:, 1], found[:, 2].astype(bool)


def _cross_lists(percent: int):
    """A function over batches sorted by list; a list may run over into later batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            both = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
            if both is None:
                return
            key = both[["token", "bi", "bj"]].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(both)]))
            last = len(starts) - 1 if batch is None else len(starts) - 2
            column = {c: both[c].to_numpy() for c in both.columns if c != "sig"} | {"sig": _matrix(both["sig"])}
            found = [_cross({c: v[starts[k] : starts[k + 1]] for c, v in column.items()}, percent)
                     for k in range(last) if starts[k + 1] - starts[k] > 1]
            if found:
                yield pd.DataFrame({c: np.concatenate([f[j] for f in found]) for j, c in enumerate(("a", "b", "probe"))})
            rest = both.iloc[starts[last] :]

    return run


def confirm_blocks(docs: DataFrame, probes: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (a, b) between each probing document (a, comp) and any member (id, comp) of its component.

    Both sides travel as blocks of about SET_BLOCK whole sets, so a component of m members and n probes meets in
    m * n / SET_BLOCK**2 rows; a probe is counted against a whole block at once.
    """
    asked = materialise(probes.distinct(), "probes")
    targets = asked.select("comp").distinct()
    held = members.join(targets, "comp", "left_semi")
    sides = []
    for rows, key in ((asked.select(F.col("a").alias("id"), "comp"), "probe"), (held.select("id", "comp"), "member")):
        size = rows.groupBy("comp").agg(F.count("*").alias("rows"))
        placed = rows.join(size, "comp").withColumn("block", F.expr(f"pmod(xxhash64(id), CAST(ceil(rows / {SET_BLOCK}.0) AS BIGINT))"))
        sets = full_sets(docs, rows.select(F.col("id").alias("key")), k)
        sides.append(placed.join(sets, "id").groupBy("comp", "block").agg(F.collect_list(F.struct("id", "shingles")).alias(key)).drop("block"))

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [], []
            for probe, member in zip(batch["probe"], batch["member"], strict=True):
                sets = [_unpacked(m["shingles"]) for m in member]
                ids, size = np.array([m["id"] for m in member]), np.array([len(s) for s in sets])
                values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                for p in probe:
                    own = _unpacked(p["shingles"])
                    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    same = np.bincount(owner[own[at] == values], minlength=len(sets))
                    hit = 100 * same >= percent * (size + len(own) - same)
                    left += [p["id"]] * int(hit.sum())
                    right += ids[hit].tolist()
            yield pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})

    met = sides[0].join(sides[1], "comp").select("probe", "member")
    return met.mapInPandas(hold, "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(signatures(docs, k), "sig")
    reps = materialise(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")).select("id", F.col("n_shingles").alias("n"), "sig", "d1", "d2"), "reps")
    posts = materialise(postings(reps, rarity(reps)), "posts")
    heads = posts.groupBy("token").agg(F.count("*").alias("length"), F.min("id").alias("pivot")).filter("length > 1")
    lists = materialise(posts.join(heads, "token"), "lists")
    release(spark, posts)
    stars = lists.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(confirm(docs, materialise(alike(stars, reps, percent), "stars"), k, percent), "links")
    first = connected_components(links)
    label = lists.join(first, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")
    label = materialise(label.filter("id <> pivot"), "labelled")  # all pairs with the pivot are settled
    release(spark, lists)
    open_lists = label.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    sizes = first.groupBy(F.col("component_id").alias("comp")).agg(F.count("*").alias("members"))
    blocks = F.expr(f"CAST(ceil(length / {LIST_BLOCK}.0) AS INT)")
    rows = (
        label.join(open_lists, "token", "left_semi").withColumn("blocks", blocks)
        .withColumn("block", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        .join(reps.select("id", "n", "sig"), "id").join(sizes, "comp", "left").fillna(1, ["members"])
    )
    columns = ["token", "bi", "bj", "block", "coordinate", "id", "comp", "members", "mask", "n", "sig"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(columns).repartition(parts, "token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "id")
    rest = materialise(dealt.mapInPandas(_cross_lists(percent), "a long, b long, probe boolean"), "rest")
    pairs = confirm(docs, materialise(rest.filter("NOT probe").select("a", "b").distinct(), "pairs"), k, percent)
    probes = rest.filter("probe").select("a", F.col("b").alias("comp"))
    held = confirm_blocks(docs, probes, first.select("id", F.col("component_id").alias("comp")), k, percent)
    more = materialise(pairs.unionByName(held), "links")
    comps = connected_components(links.unionByName(more))
    member = reps.select("d1", "d2", "n", "id").join(comps, "id", "left").select(
        "d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("class_id"))
    out = signed.drop("sig").join(member, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id.

    Every row is a document of its own: rows whose doc_id is repeated or null are told apart by their text and come
    after all others; of rows that repeat doc_id and text, one stays. Columns of any name pass through untouched.
    """
    own, some = keyed(docs)
    found = near_duplicates(own.select(F.col("key").alias("doc_id"), "text"), k, percent)
    dropped = materialise(found.filter("NOT kept").select(F.col("doc_id").alias("key")).distinct(), "dropped")
    kept = own.join(dropped, "key", "left_anti")
    if some:
        kept = kept.filter("marked IS NULL").select("src").unionByName(kept.filter("marked").dropDuplicates(["key"]).select("src"))
    return kept.select("src.*")
