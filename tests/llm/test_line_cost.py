"""Line dedup rules pairs out before it builds their sets, and loses none by that."""

import itertools
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quern.llm import lines
from test_units import edited, prose


def test_sketches_rule_out_only_pairs_that_are_not_alike(spark):
    rng = random.Random(23)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(12)] + ["again and " * 40, "x" * 300, "short", "ab"]
    texts = sorted({edited(rng, rng.choice(base), rng.choice((0, 0.01, 0.02, 0.05, 0.2))) for _ in range(120)})
    frame = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    pairs = list(itertools.combinations(range(len(texts)), 2))
    sets = [{x[i : i + 10] for i in range(max(len(x) - 10, 0) + 1)} for x in texts]
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    known = lines.parities(frame)
    assert {r.lid: r.n for r in known.collect()} == {k: len(s) for k, s in enumerate(sets)}
    left = lines.likely(known, spark.createDataFrame(pairs, "a long, b long"), 80)
    some = {(r.a, r.b) for r in left.collect()}
    assert alike and alike <= some and len(some) < len(pairs) / 2
    assert {(r.a, r.b) for r in lines.verify(known, left, 80).collect()} == alike


def test_copies_of_a_line_are_counted_where_texts_meet(spark):
    docs = spark.createDataFrame([(1, "A b\n a B \nother"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert {r.line: r.copies for r in lines.distinct_lines(lines.split_lines(docs)).collect()} == {"a b": 3, "other": 1}


def test_larger_maps_are_set_for_the_bands_only(spark):
    before = spark.conf.get(lines._CAPACITY, None)
    with lines._large_maps(spark):
        assert spark.conf.get(lines._CAPACITY) == "20"
    assert spark.conf.get(lines._CAPACITY, None) == before
