"""Language ID with interpolated Kneser-Ney character models.

Texts are lower-cased; runs of anything but letters become one space. For every language the counts of
character ``ORDER``-grams over all training texts are summed in Spark, lower orders are the Kneser-Ney
continuation counts of the order above, and the discount of each order is n1 / (n1 + 2 n2). A model is a
set of sorted hash arrays: the packed n-gram through a bijective 64-bit mix, with one column of log
probabilities a language (or of back-off weights for contexts). A text is given the language of the
lowest cross-entropy per character.

Rejection is calibrated: over all training texts, scored whole on the executors, the exact median of cross-entropy and
of the distance from it (times 1.4826) are found from counts of cells, and a text is rejected when its best cross-entropy
lies more than ``REJECT`` spreads, and ``MARGIN`` nats, above the median of that language, the spread
growing for short texts. Letters drawn at random lie about two nats above it.

The model holds every counted n-gram. Up to ``MODEL_BYTES`` it is one broadcast; a larger one is dealt into parts by the
second last letter, which an n-gram shares with its context and with all shorter n-grams it backs off to but the
single letter. Discounts and single letters then come from all counts in Spark, and the parts are broadcast one after
the other, each adding its n-grams' log probabilities to the texts' sums, so memory stays that of a part. A part
is at least one letter.

Defined cases: null text, empty text and text without a letter are ``und`` with score 0 and are rejected;
letters beyond U+FFFF count as one placeholder letter, other code points there as none; without any training text everything is
``und``; repeated rows are learned from as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.storage import materialise, release

ORDER, MODEL_BYTES, CELL, REJECT, MARGIN = 4, 64 << 20, 1e-4, 12.0, 1.2
SPACE, PLACEHOLDER = 32, 0xFFFD
_C = np.uint64(0x9E3779B97F4A7C15)
_LETTER: np.ndarray | None = None
_ASTRAL: np.ndarray | None = None


def _letter() -> np.ndarray:
    """For each UTF-16 unit: its lower-case letter, or a space."""
    global _LETTER
    if _LETTER is None:
        table = np.full(65536, SPACE, np.uint16)
        for c in range(65536):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
        _LETTER = table
    return _LETTER


def _astral() -> np.ndarray:
    """For each code point from U+10000: whether it is a letter."""
    global _ASTRAL
    if _ASTRAL is None:
        _ASTRAL = np.fromiter((chr(c).isalpha() for c in range(0x10000, 0x110000)), bool, 0x100000)
    return _ASTRAL


def _normal(text: str) -> np.ndarray:
    """Letters with single spaces between runs, one space at either end."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    letters = _letter()[units]
    high = np.flatnonzero((units[:-1] & 0xFC00) == 0xD800)
    if len(high):
        high = high[(units[high + 1] & 0xFC00) == 0xDC00]
        point = ((units[high].astype(np.int64) & 0x3FF) << 10) | (units[high + 1].astype(np.int64) & 0x3FF)
        letters[high] = np.where(_astral()[point], PLACEHOLDER, SPACE)
        letters = np.delete(letters, high + 1)
    x = np.concatenate((np.full(1, SPACE, np.uint16), letters, np.full(1, SPACE, np.uint16)))
    blank = x == SPACE
    return x[~(blank & np.concatenate(([False], blank[:-1])))]


def _grams(x: np.ndarray, order: int, start: int = 1, end: int | None = None) -> np.ndarray:
    """The packed n-gram that ends at each character from ``start`` to before ``end``; missing history is spaces."""
    end = len(x) if end is None else end
    before = x[max(start - order + 1, 0) : end].astype(np.uint64)
    n = end - start
    padded = np.concatenate((np.full(n + order - 1 - len(before), SPACE, np.uint64), before))
    key = np.zeros(n, np.uint64)
    for j in range(order):
        key = (key << np.uint64(16)) | padded[j : j + n]
    return key


def _blocks(texts, size: int = 1 << 17):
    """The n-grams of texts in a row, a few hundred thousand at a time; those of a long text in parts."""
    rows, parts, total = [], [], 0
    for k, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        x = _normal(text)
        for a in range(1, len(x), size):
            rows.append(k)
            parts.append(_grams(x, ORDER, a, min(a + size, len(x))))
            total += len(parts[-1])
            if total >= size:
                yield rows, parts
                rows, parts, total = [], [], 0
    if rows:
        yield rows, parts


def gram_counts(train: DataFrame) -> DataFrame:
    """lang, gram, n over all training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def flush(lang):
            keys = np.concatenate([k for k, _ in held[lang]])
            counts = np.concatenate([c for _, c in held[lang]])
            unique, inverse = np.unique(keys, return_inverse=True)
            held[lang] = [(unique, np.bincount(inverse, counts).astype(np.int64))]

        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=True)["text"]:
                for _, parts in _blocks(texts):
                    held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
                    if len(held[lang]) > 32:
                        flush(lang)
                if lang in held and len(held[lang][0][0]) > 1 << 20:  # bounded memory; Spark adds the rest
                    flush(lang)
                    yield pd.DataFrame({"lang": lang, "gram": held[lang][0][0].view(np.int64), "n": held.pop(lang)[0][1]})
        for lang in sorted(held):
            flush(lang)
            keys, counts = held[lang][0]
            yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": counts})

    found = train.select("lang", "text").mapInPandas(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(key: np.ndarray) -> np.ndarray:
    h = key * _C
    h ^= h >> np.uint64(31)
    return h * _C


class Table:
    """A sorted hash array with a radix index on its top bits, and a float32 column a language."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = _hash(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], np.ascontiguousarray(values[order])
        self.bits = max(1, int(len(h)).bit_length())
        self.first = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        h = _hash(keys)
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            value = self.hashes[at[open_]]
            hit = value == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * order)) - 1)


def _second_last(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(16)).astype(np.int64) & 0xFFFF


def _discount(n1: int, n2: int) -> float:
    return min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95)


class Model:
    """Kneser-Ney models of all languages, joined on the n-gram.

    ``whole`` gives (discounts by order, single letters, their counts) of each language where ``counts`` is a part.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], whole: dict[str, tuple] | None = None):
        self.langs = sorted(whole or counts)
        letters = len(np.unique(np.concatenate([w[1] for w in whole.values()] if whole else [_low(k, 1) for k, _ in counts.values()])))
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        per_lang = [self._estimate(*counts.get(lang, none), letters + 1, whole and whole[lang]) for lang in self.langs]
        self.grams, self.contexts = {}, {}
        for order in range(ORDER, 0, -1):
            self.grams[order] = self._join([p[order][0] for p in per_lang], per_lang, order)
            self.contexts[order] = self._join_contexts([p[order][1] for p in per_lang])
        self.floor = np.log(np.full(len(self.langs), 1.0 / (letters + 1), np.float32))
        self.mean, self.spread = np.zeros(len(self.langs)), np.ones(len(self.langs))

    @staticmethod
    def _estimate(keys: np.ndarray, counts: np.ndarray, letters: int, whole: tuple | None = None) -> dict:
        """For each order: {gram: log p} and {context: log back-off} as (keys, values) pairs."""
        levels = {ORDER: (keys, counts.astype(np.float64))}
        for order in range(ORDER - 1, 0, -1):
            unique, n = np.unique(_low(levels[order + 1][0], order), return_counts=True)
            levels[order] = (unique, n.astype(np.float64))
        if whole:
            levels[1] = (whole[1], whole[2].astype(np.float64))
        out, below = {}, None
        for order in range(1, ORDER + 1):
            k, n = levels[order]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = whole[0][order] if whole else _discount(n1, n2)
            context, at = np.unique(k >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            backoff = d * kinds / total
            lower = np.full(len(k), 1.0 / letters) if below is None else below[1][np.searchsorted(below[0], _low(k, order - 1))]
            p = (n - d) / total[at] + backoff[at] * lower
            below = (k, p)
            out[order] = ((k, np.log(p)), (context, np.log(backoff)))
        return out

    def _join(self, tables, per_lang, order) -> Table:
        keys = np.unique(np.concatenate([k for k, _ in tables]))
        values = np.empty((len(keys), len(tables)), np.float32)
        for c, p in enumerate(per_lang):
            values[:, c] = self._score_one(p, keys, order, len(tables))
        return Table(keys, values)

    def _score_one(self, p, keys, order, _) -> np.ndarray:
        """log p of every key under one language, backing off where it was not seen."""
        (k, v), (ck, cv) = p[order]
        if not len(k):
            return self._score_one(p, _low(keys, order - 1), order - 1, _)
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        seen = k[at] == keys
        out = np.where(seen, v[at], 0.0)
        rest = keys[~seen]
        if len(rest):
            c = rest >> np.uint64(16)
            ca = np.minimum(np.searchsorted(ck, c), len(ck) - 1)
            weight = np.where(ck[ca] == c, cv[ca], 0.0)
            lower = self._score_one(p, _low(rest, order - 1), order - 1, _) if order > 1 else np.full(len(rest), -12.0)
            out[~seen] = weight + lower
        return out

    def _join_contexts(self, tables) -> Table:
        keys = np.unique(np.concatenate([k for k, _ in tables]))
        values = np.zeros((len(keys), len(tables)), np.float32)
        for c, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), c] = v
        return Table(keys, values)

    def log_p(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        at = self.grams[order].find(keys)
        out = self.grams[order].values[at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            rest = keys[lost]
            c = self.contexts[order].find(rest >> np.uint64(16))
            weight = np.where((c >= 0)[:, None], self.contexts[order].values[c], 0.0)
            lower = self.log_p(_low(rest, order - 1), order - 1) if order > 1 else np.broadcast_to(self.floor, (len(rest), len(self.langs)))
            out[lost] = weight + lower
        return out

    def sums(self, texts, share: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities (texts x languages) and the number of characters scored, of the n-grams of a part."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for rows, parts in _blocks(texts):
            if share[1] > 1:
                parts = [x[_second_last(x) % share[1] == share[0]] for x in parts]
                rows, parts = [r for r, x in zip(rows, parts, strict=True) if len(x)], [x for x in parts if len(x)]
                if not rows:
                    continue
            length = np.array([len(p) for p in parts])
            p = self.log_p(np.concatenate(parts))
            part = np.add.reduceat(p, np.concatenate(([0], np.cumsum(length)[:-1])), axis=0, dtype=np.float64)
            np.add.at(total, rows, part)
            np.add.at(n, rows, length)
        return total, n


class Parts:
    """Models of all parts, built one at a time from the counts."""

    def __init__(self, counts: DataFrame, size: int, langs: list[str]):
        self.counts, self.langs, self.size = counts, langs, size
        self.mean, self.spread = np.zeros(len(langs)), np.ones(len(langs))
        self.whole = self._whole() if size > 1 else None

    def _whole(self) -> dict[str, tuple]:
        level, found = self.counts, []
        for order in range(ORDER, 0, -1):
            if order < ORDER:  # continuation counts of the order above
                level = level.select("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
            found.append(level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).withColumn("order", F.lit(order)))
        stats = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).collect()  # one a language and order
        letters = level.toPandas()  # at most 65,536 a language
        out = {}
        for lang in self.langs:
            own = letters[letters["lang"] == lang].sort_values("gram")
            out[lang] = ({r["order"]: _discount(r["n1"], r["n2"]) for r in stats if r["lang"] == lang}, own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy())
        return out

    def model(self, part: int) -> Model:
        rows = self.counts
        if self.size > 1:
            rows = rows.filter(F.pmod(F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFF)), F.lit(self.size)) == part)
        table = rows.select("lang", "gram", "n").toPandas()
        by_lang = {lang: g.sort_values("gram", key=lambda s: s.to_numpy().view(np.uint64)) for lang, g in table.groupby("lang")}
        return Model({lang: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for lang, g in by_lang.items()}, self.whole)


def _fit(train: DataFrame) -> Parts | None:
    """Models of ``train`` (text, lang) without rejection limits; rows without text or lang are ignored."""
    counts = materialise(gram_counts(train.filter("text IS NOT NULL AND lang IS NOT NULL")), "grams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    # A row of the tables is a hash and a column a language, for n-grams and contexts of each order.
    return Parts(counts, -(-sum(sizes.values()) * 2 * (8 + 4 * len(sizes)) // MODEL_BYTES), sorted(sizes))


def _medians(values: DataFrame) -> dict[str, float]:
    """The exact median of v by lang. Counts of cells of ``CELL`` come to the driver, then the values of the middle cells."""
    cells = values.withColumn("cell", F.floor(F.col("v") / CELL))
    counts = cells.groupBy("lang", "cell").count().toPandas().sort_values(["lang", "cell"])
    places, wanted = {}, []
    for lang, own in counts.groupby("lang"):
        upto = own["count"].cumsum().to_numpy()
        for rank in {(upto[-1] - 1) // 2, upto[-1] // 2}:
            k = int(np.searchsorted(upto, rank, side="right"))
            cell = int(own["cell"].iloc[k])
            places.setdefault(lang, []).append((cell, rank - (upto[k - 1] if k else 0)))
            wanted.append((lang, cell))
    if not wanted:
        return {}
    middle = cells.join(F.broadcast(cells.sparkSession.createDataFrame(sorted(set(wanted)), "lang string, cell long")), ["lang", "cell"])
    found = {key: own.sort_values("v") for key, own in middle.groupBy("lang", "cell", "v").count().toPandas().groupby(["lang", "cell"])}

    def value(lang, cell, rank):
        own = found[(lang, cell)]
        return float(own["v"].iloc[int(np.searchsorted(own["count"].cumsum().to_numpy(), rank, side="right"))])

    return {lang: float(np.mean([value(lang, *place) for place in own])) for lang, own in places.items()}


def _calibrate(parts: Parts, scores: DataFrame) -> Parts:
    """Set the middle and the spread of the cross-entropy of each language from all of ``scores`` (lang, _sums, _n)."""
    at = F.create_map(*[F.lit(x) for k, lang in enumerate(parts.langs) for x in (lang, k)])
    own = scores.filter(F.col("_n") >= 20).select("lang", (-F.get("_sums", at[F.col("lang")]) / F.col("_n")).alias("v")).filter("v IS NOT NULL")
    own = materialise(own, "entropies")
    mean = _medians(own)
    if mean:
        middle = F.create_map(*[F.lit(x) for pair in mean.items() for x in pair])
        spread = _medians(own.select("lang", F.abs(F.col("v") - middle[F.col("lang")]).alias("v")))
        for c, lang in enumerate(parts.langs):
            if lang in mean:
                parts.mean[c], parts.spread[c] = mean[lang], max(1.4826 * spread[lang], 0.02)
    release(scores.sparkSession, own)
    return parts


def train_model(train: DataFrame) -> Parts | None:
    """Fit on ``train`` (text, lang); rows without text or lang are ignored. All of them set the rejection limits."""
    train = train.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    parts = _fit(train)
    return parts and _calibrate(parts, scored(train, parts).select("lang", "_sums", "_n"))


def scored(docs: DataFrame, parts: Parts) -> DataFrame:
    """``docs`` with _sums (log probabilities of the text by language) and _n (characters). Columns travel as Arrow,
    so any type and null survives."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())])
    at, width, before = docs.columns.index("text"), len(docs.columns), None
    for part in range(parts.size):
        shared = docs.sparkSession.sparkContext.broadcast(parts.model(part))

        def run(batches: Iterator[pa.RecordBatch], part=part, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, n = shared.value.sums(batch.column(at).to_pylist(), (part, size))
                if part:
                    total += np.array(batch.column(width).to_pylist()).reshape(total.shape)
                    n += batch.column(width + 1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.array(list(total), pa.list_(pa.float64())), pa.array(n)], names=[*batch.schema.names[:width], "_sums", "_n"])

        size = parts.size
        docs = docs.mapInArrow(run, schema)
        if size > 1:  # one part in memory at a time
            docs = materialise(docs, "scores")
            if before is not None:
                release(docs.sparkSession, before)
            before = docs
            shared.unpersist()
    return docs


def predict(docs: DataFrame, model: Parts | None, keep_only: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy and rejected; with ``keep_only``, just the
    rows that are not rejected, as they are."""
    at, width = docs.columns.index("text"), len(docs.columns)
    names, schema = docs.columns, T.StructType(docs.schema.fields + ([] if keep_only else [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    langs, mean, spread, one = (model.langs, model.mean, model.spread, model.size == 1) if model else (None, None, None, False)
    shared = docs.sparkSession.sparkContext.broadcast(model.model(0)) if one else None

    def judge(total: np.ndarray, n: np.ndarray):
        best, some = total.argmax(axis=1), n > 0
        per = np.where(some, -total[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
        # A posterior over at most 40 characters' worth of evidence, so that it does not saturate.
        evidence = (total - total.max(axis=1, keepdims=True)) * (np.minimum(n, 40) / np.maximum(n, 1))[:, None]
        score = np.where(some, 1.0 / np.exp(evidence).sum(axis=1), 0.0)
        limit = mean[best] + np.maximum(MARGIN, REJECT * spread[best] * (1 + 10 / np.sqrt(np.maximum(n, 1))))
        return np.where(some, np.array(langs, dtype=object)[best], "und").tolist(), score, per, ~some | (per > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if langs is None or not rows:
                lang, score, per, rejected = ["und"] * rows, np.zeros(rows), np.zeros(rows), np.ones(rows, bool)
            elif one:
                lang, score, per, rejected = judge(*shared.value.sums(batch.column(at).to_pylist()))
            else:
                lang, score, per, rejected = judge(np.array(batch.column(width).to_pylist()), batch.column(width + 1).to_numpy())
            kept = pa.RecordBatch.from_arrays(batch.columns[:width], names=names)
            if keep_only:
                yield kept.filter(pa.array(~rejected))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(per), pa.array(rejected)],
                    names=[*names, "lang_pred", "score", "cross_entropy", "rejected"])

    return (scored(docs, model) if model and not one else docs).mapInArrow(run, schema)


def held_out(column: str = "doc_id", modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected; learned from the rows not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train_model(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; the models learn from all rows that have a ``lang``."""
    return predict(docs, train_model(docs.select("doc_id", "text", "lang")), keep_only=True)
