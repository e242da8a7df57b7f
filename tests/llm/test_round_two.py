"""Cases that once lost rows, departed from a contract or were settled without the method."""

import itertools
import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quern.llm import decontam, fingerprint, grid, langid, lines, near, packing, wordhash
from test_units import components, make, prose


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    long = "one text that several rows of this table hold in full"
    rows = [(1, long, 1, "a"), (2, "unique words that stand nowhere else here", 2, "b"), (2, long, 3, "c"), (None, "first row without an id", 4, "d"), (None, long, 5, "e"), (None, None, 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, marked string")
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == [1, 2, 4, 6]
    left = lines.dedup_lines(docs)
    assert left.columns == docs.columns and sorted(r.key for r in left.collect()) == [1, 2, 4, 6]


def test_columns_of_clashing_names_pass_through(spark):
    text = "a line of text that is long enough to be compared"
    names = ["gone", "new", "src", "row", "h", "lid", "best", "key", "again", "marked", "_gone", "_new", "_id"]
    docs = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in enumerate([text, text + "\nother words stand on this line", "short"])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for out, want in ((lines.dedup_lines(docs), [0, 1, 2]), (near.drop_near_duplicates(docs), [0, 1, 2])):
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want
        assert all(set(r[2:]) == {"x"} for r in out.collect())


def test_a_hot_bucket_of_lines_equals_brute_force(spark):
    rng = random.Random(13)
    shared = prose(rng, 12)
    texts = [f"{shared} {prose(rng, rng.choice((1, 2, 4, 8)), 10**6)}" for _ in range(260)]
    texts += [t + rng.choice(("", "x", "yy")) for t in texts[:60]]
    distinct = sorted(set(texts))
    sets = {x: {x[i : i + 10] for i in range(max(len(x) - 10, 0) + 1)} for x in distinct}
    comp = components([(a, b) for a, b in itertools.combinations(distinct, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], distinct)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(comp[t], i)
    lines_ = make(spark, texts)
    assert {r.doc_id: r.first_doc_id for r in lines.line_classes(lines_).collect()} == {i: first[comp[t]] for i, t in enumerate(texts)}


def test_blocks_find_links_between_components(spark):
    base = [f"some line number {k} with its own words {k * 7919} and more {k * 104729}" for k in range(6)]
    texts = spark.createDataFrame([(k + 10 * j, b + "." * j) for k, b in enumerate(base) for j in range(3)], "lid long, line string")
    label = texts.selectExpr("1L AS band", "lid", "lid AS c")
    got = components([(r.a, r.b) for r in lines.block_links(texts, label, 80).collect()], [k + 10 * j for k in range(6) for j in range(3)])
    assert got == {k + 10 * j: k for k in range(6) for j in range(3)}


def test_only_letters_make_a_language(spark):
    rows = [(i, "der hund und die katze " * 3, "de") for i in range(8)] + [(20, "😀😀 🎉", None), (21, "\U0001f600", None), (22, "𝐀𝐁", None), (23, "12 ٣", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert (got[20], got[21], got[22], got[23]) == ("und", "und", "de", "und")


def test_history_runs_over_the_parts_of_a_long_text():
    text = "abcdefgh " * 5000
    whole = langid._grams(langid._normal(text), langid.ORDER)
    parts = np.concatenate([p for _, ps in langid._blocks([text], 700) for p in ps])
    assert (whole == parts).all() and len(whole) == len(langid._normal(text)) - 1


def test_model_equals_plain_kneser_ney():
    words = "abracadabra abba cab bad dab caba"
    keys, counts = np.unique(langid._grams(langid._normal(words), 4), return_counts=True)
    model, x = langid.Model({"a": (keys, counts)}), langid._normal(words).tolist()
    grams = [tuple(([32, 32] + x)[i : i + 4]) for i in range(len(x) - 1)]
    levels = {4: {g: grams.count(g) for g in set(grams)}}
    for n in (3, 2, 1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / (len({g[-1] for g in grams}) + 1)
        level = levels[len(g)]
        n1, n2 = (sum(v == k for v in level.values()) for k in (1, 2))
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95)
        after = {h: v for h, v in level.items() if h[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        return max(level.get(g, 0) - d, 0) / total + d * len(after) / total * p(g[1:])

    pack = lambda g: np.array([sum(c << (16 * (3 - i)) for i, c in enumerate(g))], np.uint64)
    for g in [*set(grams), *((a, b, c, e) for a, b, c, e in itertools.product(map(ord, "abcd"), repeat=4))]:
        assert abs(float(model.log_p(pack(g))[0, 0]) - np.log(p(g))) < 1e-4


def test_local_search_empties_bins_that_best_fit_leaves():
    sizes = np.minimum(np.maximum(np.random.default_rng(1).lognormal(5.3, 1.2, 6000).astype(int), 1), 2048).tolist()
    dealt = packing.best_fit(sizes, 2048)
    found = packing.local_search([list(b) for b in dealt], sizes, 2048)
    assert sorted(itertools.chain(*found)) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in found)
    assert len(dealt) > len(found) == -(-sum(sizes) // 2048) and packing.pack_sizes(sizes) == found


def test_ranges_of_documents_may_be_many(spark):
    docs = make(spark, [f"text number {i} of many words that are its own {i * 7}" for i in range(300)] + [None], [*range(300), None])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        ranged = fingerprint.in_ranges(docs.select("doc_id", "text")).coalesce(4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = {r.doc_id: r.range for r in ranged if not r.tail}
    assert len(own) == 301
    following = {r.range: r.doc_id for r in ranged if r.tail}
    heads = sorted({min((d for d in own if d is not None and own[d] == k), default=10**9) for k in set(own.values())})
    assert all(following[own[h - 1]] == h for h in heads if 0 < h < 10**9)


def test_every_text_of_an_item_is_looked_for(spark):
    rng = random.Random(4)
    one, two = prose(rng, 25, 10**5), prose(rng, 25, 10**5)
    bench = spark.createDataFrame([(1, one), (1, two), (2, one)], "item_id long, text string")
    body = lambda: prose(rng, 60, 10**5)
    rows = [(1, f"{body()} {two} {body()}"), (2, f"{body()} {one}"), (3, f"{one} {two}"), (4, body()), (7, f"{one} {body()}"), (7, body()), (None, f"{body()} {two}"), (None, body())]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, src string, key string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert found == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (7, 1), (7, 2)}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted((i or -1, rows[k][1]) for k, (i, _) in enumerate(rows) if k in (3, 5, 7))


def test_long_words_hash_by_all_of_their_bytes():
    a, b = b"a" * 4096, b"b" * 4096
    h = wordhash.words([a + b, b + a, a + b + a, a + a + b, a + b])[0].tolist()
    assert len(set(h)) == 4 and h[0] == h[4]


def test_blocks_of_a_grid_travel_packed():
    for block in (np.zeros(1 << 14, np.uint8), np.eye(1, 1 << 14, 77, dtype=np.int64)[0] * 9, np.arange(1 << 14, dtype=np.int64)):
        at, values = grid._unpacked(grid._packed(block), 1 << 14, block.dtype)
        out = np.zeros_like(block)
        out[at] = values
        assert (out == block).all()
