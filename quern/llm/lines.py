"""Fuzzy line dedup with DataFrame functions only.

Lines (text split at ``\\n``) are compared trimmed and lower-cased. Equal lines meet as text, once, before anything
is computed from them; later steps name a line by a 64-bit hash, and lines that share one get another name. A line's
set is its ``SHINGLE``-character shingles; every shingle's hash falls into one of ``BANDS * ROWS`` cells and the
smallest of a cell is a coordinate of the line's signature, as filtered minima of one group a line inside one generated stage (one-permutation
MinHash; a cell without shingle equals another such). ``ROWS`` coordinates make a band: a pair at similarity 0.8 shares one but for 2 in 10,000.

In each band's bucket every line is held against the smallest line; pairs that sketches do not rule out, without loss, are verified by
the Jaccard similarity of their whole shingle sets, as 64-bit hashes, and joined by the distributed union-find. Buckets that still hold several components have their lines held
against another line, up to ``TURNS`` times while that finds links for a share of ``WORTH`` of them. Of what is then open, the
lines outside of one line's component are gathered into blocks of whole lines of about one size and held against all other
lines of the bucket that are not too long or short for them, block by block, inside the row of two blocks, each pair in one of
the buckets that it shares; what leaves the row is the distinct pairs of linked components, so no bucket is met as pairs of rows
and no link is lost to the choice of a pivot. One line of every component stays: the first by doc_id (nulls last) and line.

Defined cases: null text has no lines; blank lines are never compared and always stay; a line shorter than a
shingle is one shingle, so it matches only equal lines; rows that repeat a doc_id, null too, are told apart by a
hash of their text, and rows equal in both are kept or dropped together; a line is held whole in a row's memory;
columns of any other name pass through ``dedup_lines`` untouched.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.storage import materialise, release
from quern.llm.components import connected_components

SHINGLE, BANDS, ROWS = 10, 12, 3
ENOUGH = 0  # coordinates that must agree, besides those of a shared band, before a pair is verified
TURNS, WORTH = 5, 0.05
BLOCK_LINES, BLOCK_CHARS, DEALT_BLOCKS, WORDS = 64, 1 << 16, 8, 16
_MASK = (1 << 31) - 1
_CAPACITY = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text, tells rows of one doc_id apart), line_no (from 0) and line (trimmed, lower-cased) of every line that is not blank."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.split("text", "\n").alias("parts"))  # one hash a row, not one a line
    raw = parts.select("doc_id", "row", F.posexplode("parts").alias("line_no", "raw"))
    trimmed = raw.select("doc_id", "row", "line_no", F.trim("raw").alias("line")).filter("line <> ''")  # before lower, which would run again in the filter
    return trimmed.withColumn("line", F.lower("line"))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2")]


def distinct_lines(lines: DataFrame) -> DataFrame:
    """lid, h, h2, line, copies of every different line; lid is h but for lines that share it."""
    spark = lines.sparkSession
    texts = materialise(lines.groupBy("line").agg(F.count("*").alias("copies")).select("line", "copies", *_hashes()), "line-texts")
    shared = materialise(texts.groupBy("h").count().filter("count > 1").select("h"), "line-shared")
    if shared.isEmpty():
        release(spark, shared)
        return texts.withColumn("lid", F.col("h"))
    other = texts.join(shared.select("h", F.lit(True).alias("again")), "h", "left")
    return other.withColumn("lid", F.when(F.col("again"), F.xxhash64("h2", "h")).otherwise(F.col("h"))).drop("again")


_LAST = f"greatest(CAST(length(units) / 2 AS INT) - {SHINGLE}, 0)"
_CUT = f"substring(units, 2 * i + 1, {2 * SHINGLE})"
# Of a line u in code points of four bytes.
_TO = f"greatest(length(u) - {4 * SHINGLE}, 0) + 1"
_POINTS = f"substring(u, i, {4 * SHINGLE})"


def postings(texts: DataFrame) -> DataFrame:
    """lid and band (a hash of the band's number and its coordinates) of every band of a line that a shingle falls into.

    One group a line, and a filter a coordinate: the generated code then looks a line up once a shingle and compares numbers.
    """
    cells = BANDS * ROWS
    shingles = (
        texts.select("lid", "line").repartition("lid").select("lid", F.encode("line", "UTF-16BE").alias("units"))
        .select("lid", "units", F.explode(F.expr(f"sequence(0, {_LAST})")).alias("i"))
        .select("lid", F.expr(f"xxhash64({_CUT})").alias("x"))
        .select("lid", "x", F.expr(f"CAST(shiftrightunsigned(shiftrightunsigned(x, 32) * {cells}L, 32) AS INT)").alias("cell"))
    )
    low = shingles.groupBy("lid").agg(*[F.expr(f"min(x) FILTER (WHERE cell = {k})").alias(f"m{k}") for k in range(cells)])
    bands = []
    for k in range(BANDS):
        own = [f"m{k + BANDS * r}" for r in range(ROWS)]
        bands.append(F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.lit(k), *[F.coalesce(m, F.lit(0)) for m in own])))
    return low.select("lid", F.explode(F.array(*bands)).alias("band")).filter("band IS NOT NULL")


def _shingles(line: str) -> str:
    """The shingles of a line, as text."""
    return f"if(char_length({line}) < {SHINGLE}, array({line}), regexp_extract_all({line}, '(?s)(?=(.{{{SHINGLE}}}))', 1))"


def _hashed(line: str) -> str:
    """The shingles of a line as 64-bit hashes, repeats too; built from code points of four bytes, several times faster than the shingles as text."""
    return f"transform(array(encode({line}, 'UTF-32')), u -> transform(sequence(1, {_TO}, 4), i -> xxhash64({_POINTS})))[0]"


def _sketch_bits(x: str, y: str, words: int = WORDS) -> str:
    """The bits in which two parity sketches differ: never more than the shingles in which the sets differ."""
    return " + ".join(f"bit_count({x}o{j} ^ {y}o{j})" for j in range(words))


def _common(x: str, y: str) -> str:
    return f"size(array_intersect({_shingles(x)}, {_shingles(y)}))"


def likely(sketches: DataFrame, pairs: DataFrame, percent: int, counted: bool = True) -> DataFrame:
    """The pairs (a, b) of line ids but for those whose sizes or sketches rule out, without loss, that they reach the similarity.

    Not ``counted``: n is no less than the size of the line's set, so it bounds differences only.
    """
    columns = ["n", *[f"o{j}" for j in range(WORDS)]]
    one, two = (sketches.select(F.col("lid").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns]) for c in "ab")
    sizes = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)" if counted else "true"
    near = f"{100 + percent} * ({_sketch_bits('a_', 'b_')}) <= {100 - percent} * (a_n + b_n)"
    return pairs.join(one, "a").join(two, "b").filter(F.expr(f"{sizes} AND {near}")).select("a", "b")


def verify(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of line ids whose shingle sets reach the similarity. Only ``texts`` (lid, line) move; sets live within a row."""
    one, two = (texts.select(F.col("lid").alias(c), F.col("line").alias(f"{c}_line")) for c in "ab")
    # Generated, so that the filter does not build the sets again at each mention.
    sets = F.expr(f"inline(array(struct(array_distinct({_hashed('a_line')}) AS x, array_distinct({_hashed('b_line')}) AS y)))")
    exact = f"{100 + percent} * size(array_intersect(x, y)) >= {percent} * (size(x) + size(y))"
    return pairs.join(one, "a").join(two, "b").select("a", "b", sets).filter(exact).select("a", "b")


def _held(percent: int) -> str:
    """The distinct pairs of components that the lines of two blocks (l, r) of one bucket link.

    Sketches only rule out pairs that do not reach the similarity; what is left is tested on the shingles.
    """
    # A part of the words is tested before all of them: it rules most pairs out.
    few, bits = (f"{100 + percent} * ({_sketch_bits('x.', 'y.', words)}) <= {100 - percent} * (x.n + y.n)" for words in (WORDS // 4, WORDS))
    sizes = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    exact = f"{100 + percent} * {_common('x.line', 'y.line')} >= {percent} * (x.n + y.n)"
    first = "array_min(array_intersect(x.bands, y.bands)) = band"
    test = f"x.c <> y.c AND (apart OR x.lid < y.lid) AND {sizes} AND {few} AND {bits} AND {first} AND {exact}"
    return f"array_distinct(flatten(transform(l, x -> transform(filter(r, y -> {test}), y -> struct(least(x.c, y.c) AS a, greatest(x.c, y.c) AS b)))))"


def _class(percent: int) -> Column:
    """A class of n such that sets that reach the similarity are of the same class or of neighbouring ones."""
    width = max(math.log(100 / percent) * 1.0001, 0.01)
    return F.expr(f"CAST(floor(ln(n) / {width}D) AS INT)")


def parities(texts: DataFrame) -> DataFrame:
    """lid, line, n (its distinct shingles) and the parity sketch o0..: every shingle flips one of 64 * WORDS bits."""
    each = texts.select("lid", F.explode(F.expr(f"array_distinct({_hashed('line')})")).alias("x"))
    each = each.select("lid", F.expr(f"CAST(x & {WORDS - 1} AS INT)").alias("word"), F.expr("shiftleft(1L, CAST(shiftright(x, 8) & 63 AS INT))").alias("bit"))
    flip = [F.expr(f"coalesce(bit_xor(bit) FILTER (WHERE word = {j}), 0L)").alias(f"o{j}") for j in range(WORDS)]
    return each.groupBy("lid").agg(F.count("*").alias("n"), *flip).join(texts.select("lid", "line"), "lid")


def occupied(texts: DataFrame) -> DataFrame:
    """lid, n (its shingles, repeats too) and a sketch o0..: every shingle sets one of 64 * WORDS bits.

    Two sketches differ in no more bits than the sets in shingles, as those of :func:`parities`; repeats change nothing,
    so no set is built, and all of it is generated code.
    """
    each = (
        texts.select("lid", F.encode("line", "UTF-32").alias("u")).select("lid", "u", F.explode(F.expr(f"sequence(1, {_TO}, 4)")).alias("i"))
        .select("lid", F.expr(f"xxhash64({_POINTS})").alias("x"))
        .select("lid", F.expr(f"CAST(x & {WORDS - 1} AS INT)").alias("word"), F.expr("shiftleft(1L, CAST(shiftright(x, 8) & 63 AS INT))").alias("bit"))
    )
    return each.groupBy("lid").agg(F.count("*").alias("n"), *[F.expr(f"coalesce(bit_or(bit) FILTER (WHERE word = {j}), 0L)").alias(f"o{j}") for j in range(WORDS)])


def _bucket_pivots(label: DataFrame, turn: int) -> DataFrame:
    """``label`` (band, lid, c) with one line of the bucket, another each turn, as pivot, and its component as own."""
    flip = F.lit(random.Random(turn).getrandbits(63))
    pivots = label.groupBy("band").agg(F.min(F.col("lid").bitwiseXOR(flip)).bitwiseXOR(flip).alias("pivot"))
    own = label.select("band", F.col("lid").alias("pivot"), F.col("c").alias("own"))
    return label.join(pivots, "band").join(own, ["band", "pivot"])


def _open(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """band, lid, c (component) of the buckets that hold several components."""
    label = buckets.join(comps.select(F.col("id").alias("lid"), F.col("component_id").alias("c")), "lid", "left").select(
        "band", "lid", F.coalesce("c", "lid").alias("c"))
    still = label.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band")
    return materialise(label.join(still, "band", "left_semi"), "line-open")


def _dealt(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of each bucket that are held against others, and the visits of those others, by band, k and share."""
    # The blocks outside of the pivot's component are dealt to shares, which the bucket's blocks of a class of size beside theirs visit;
    # few enough shares that the visits of a large bucket stay well below the square of its blocks.
    outside = held.filter("NOT inside")
    shares = outside.select("band", "k", F.expr(f"CAST(ceil(least(blocks / {DEALT_BLOCKS}, sqrt(blocks))) AS INT)").alias("shares")).distinct()
    left = outside.join(shares, ["band", "k"]).select("band", "k", F.expr("pmod(block, shares)").alias("share"), F.col("block").alias("bl"), F.col("lines").alias("l"))
    beside = held.select("band", F.explode(F.expr("array(k - 1, k, k + 1)")).alias("k"), F.col("k").alias("kr"), "inside", F.col("block").alias("br"), F.col("lines").alias("r"))
    right = beside.join(shares, ["band", "k"]).filter("inside OR kr >= k").withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))).drop("shares")
    return left, right


def block_links(texts: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of components that the lines of a bucket link; ``label`` has band, lid, c, ``texts`` lid and line, and what :func:`parities` adds if at hand."""
    spark = texts.sparkSession
    # A pair is tested in the first of the buckets that it shares, so each line brings the names of its own.
    named = label.groupBy("lid").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    known = texts if "n" in texts.columns else parities(texts.join(named.select("lid"), "lid", "left_semi"))
    known = materialise(known.join(named, "lid").withColumn("k", _class(percent)), "line-parities")
    sided = _bucket_pivots(label, 0).select("band", "lid", "c", (F.col("c") == F.col("own")).alias("inside")).join(known, "lid")
    sided = materialise(sided, "line-sided")
    blocks = F.expr(f"CAST(ceil(greatest(count(*) / {BLOCK_LINES}, sum(char_length(line)) / {BLOCK_CHARS})) AS INT)")
    sizes = sided.groupBy("band", "k", "inside").agg(blocks.alias("blocks"))
    placed = sided.join(sizes, ["band", "k", "inside"]).withColumn("block", F.expr("CAST(pmod(xxhash64(lid), blocks) AS INT)"))
    member = F.struct("lid", "c", "n", "bands", *[f"o{j}" for j in range(WORDS)], "line")
    held = materialise(placed.groupBy("band", "k", "inside", "block", "blocks").agg(F.collect_list(member).alias("lines")), "line-blocks")
    left, right = _dealt(held)
    # By number: the rows are few and small, and each is a block's work, so they are not to be put together by size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(parts, "band", "k", "share") for side in (left, right))
    met = left.join(right, ["band", "k", "share"]).filter("inside OR kr > k OR br >= bl").select("band", F.expr("inside OR kr > k OR br > bl").alias("apart"), "l", "r")
    edges = materialise(met.select(F.inline(F.expr(_held(percent)))).distinct(), "line-edges")
    for frame in (known, sided, held):
        release(spark, frame)
    return edges


@contextmanager
def _large_maps(spark: SparkSession) -> Iterator[None]:
    """Plans made inside aggregate up to 2**20 groups in generated maps, which take a third less time than the general ones beyond 2**16."""
    before = spark.conf.get(_CAPACITY, None)
    spark.conf.set(_CAPACITY, "20")
    try:
        yield
    finally:
        spark.conf.set(_CAPACITY, before) if before else spark.conf.unset(_CAPACITY)


def line_components(texts: DataFrame, percent: int = 80) -> DataFrame:
    """id and component_id of every line of ``texts`` (lid, line) that is linked with a different one."""
    spark = texts.sparkSession
    with _large_maps(spark):
        posted = materialise(postings(texts), "line-posted")  # the dealt texts are off the disk before the bands are dealt
    # Nearly all bands are of a single line: they are counted without a sort, and the few others find their lines by a join.
    ends = posted.repartition("band").groupBy("band").agg(F.min("lid").alias("pivot"), F.max("lid").alias("last"))
    shared = materialise(ends.filter("pivot <> last").select("band", "pivot"), "line-shared-bands")
    buckets = materialise(posted.join(shared, "band").filter("lid <> pivot"), "line-buckets")
    release(spark, posted)
    release(spark, shared)
    members = materialise(buckets.select("lid").unionByName(buckets.select(F.col("pivot").alias("lid"))).distinct(), "line-members")
    near = materialise(texts.select("lid", "line").join(members, "lid", "left_semi"), "line-near")
    release(spark, members)
    known, rough = None, materialise(occupied(near), "line-rough")  # known: the sketches of the lines that are open after the first turn
    stars, comps = buckets.select(F.col("pivot").alias("a"), F.col("lid").alias("b")).distinct(), None
    for turn in range(1, TURNS + 2):
        stars = materialise(stars, "line-stars")  # its size is then known: few pairs are broadcast to the texts, which stay in place
        pairs = materialise(likely(known or rough, stars, percent, bool(known)), "line-likely")
        release(spark, stars)
        links = materialise(verify(near, pairs, percent), "line-links")
        release(spark, pairs)
        found = links.count()
        if found:
            comps = connected_components(links if comps is None else links.unionByName(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b"))))
        elif comps is None:
            comps = connected_components(links)
        label = _open(buckets, comps)  # pairs with a bucket's first pivot are settled
        left = label.count()
        if left and not known:
            known = materialise(parities(near.join(materialise(label.select("lid").distinct(), "line-open-lids"), "lid", "left_semi")), "line-sketches")
        if turn > TURNS or not left or found < left * WORTH:
            break
        stars = _bucket_pivots(label, turn).filter("c <> own").select(F.least("pivot", "lid").alias("a"), F.greatest("pivot", "lid").alias("b")).distinct()
    if left:
        edges = block_links(known, label, percent)
        comps = connected_components(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(edges))
    for frame in (near, rough, buckets, label, *([known] if known else [])):
        release(spark, frame)
    return comps


def line_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, line_no, kept, first_doc_id, first_line_no of every line that is not blank.

    (first_doc_id, first_line_no) is the occurrence that stays for the line's component.
    """
    return _row_classes(docs, percent).drop("row")


def _row_classes(docs: DataFrame, percent: int) -> DataFrame:
    """:func:`line_classes` with the row of each line."""
    spark = docs.sparkSession
    lines = split_lines(docs)
    texts = distinct_lines(lines)
    classes = materialise(line_components(texts, percent), "line-classes")
    seen = materialise(lines.select("doc_id", "row", "line_no", *_hashes()), "line-places")
    # Only lines with copies or links need a place chosen; the others are their own first occurrence.
    shared = materialise(
        texts.select("lid", "h", "h2", "copies").join(classes.withColumnRenamed("id", "lid"), "lid", "left")
        .filter("copies > 1 OR component_id IS NOT NULL").select("h", "h2", F.coalesce("component_id", "lid").alias("component_id")), "line-shared")
    release(spark, texts)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "row")
    best = seen.join(shared, ["h", "h2"]).groupBy("component_id").agg(F.min(place).alias("best"))
    target = materialise(shared.join(best, "component_id").select("h", "h2", "best"), "line-firsts")
    out = seen.join(target, ["h", "h2"], "left").withColumn("best", F.coalesce("best", place))
    return out.select(
        "doc_id", "row", "line_no", F.expr("doc_id <=> best.doc_id AND line_no = best.line_no AND row = best.row").alias("kept"),
        F.col("best.doc_id").alias("first_doc_id"), F.col("best.line_no").alias("first_line_no"))


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with every line dropped that another occurrence stands for; ``n_chars``, if there, follows.

    A document that had lines and loses all of them is a copy of what stays elsewhere and is left out.
    """
    gone = _row_classes(docs, percent).filter("NOT kept").groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone"))
    # The source row travels as one struct, so no column of it can clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    joined = own.join(gone, own["id"].eqNullSafe(gone["doc_id"]) & (own["hash"] == gone["row"]), "left").select("src", "gone")
    left = F.array_join(F.filter(F.split("src.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    joined = joined.withColumn("new", F.when(F.col("gone").isNull(), F.col("src.text")).otherwise(left))
    kept = joined.filter(F.col("gone").isNull() | (F.trim(F.replace("new", F.lit("\n"), F.lit(" "))) != ""))
    values = {"text": F.col("new")} | ({"n_chars": F.length("new").cast("long")} if "n_chars" in docs.columns else {})
    return kept.select(*[values.get(c, F.col(f"src.`{c}`")).alias(c) for c in docs.columns])
