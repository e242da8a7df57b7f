"""Line dedup's steps do their work once, in generated code, and lose nothing by it."""

import itertools
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quern.llm import lines
from test_units import edited, prose


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def odd_lines():
    rng = random.Random(31)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(10)] + ["again and " * 40, "ab" * 90, "short", "x", "\U0001f600é " * 60]
    base += ["".join(rng.choice("abcdefgh \U0001f600\U0001d400é") for _ in range(200)) for _ in range(6)]
    return sorted({*base, *(edited(rng, rng.choice(base), rng.choice((0.01, 0.02, 0.05))) for _ in range(60)), *(t[:90] + "\U0001f600" + t[91:] for t in base if len(t) > 150)})


def alike(texts):
    sets = [{x[i : i + 10] for i in range(max(len(x) - 10, 0) + 1)} for x in texts]
    return {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_sketches_without_sets_lose_no_pair(spark):
    texts = odd_lines()
    frame = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    every = spark.createDataFrame(list(itertools.combinations(range(len(texts)), 2)), "a long, b long")
    left = lines.likely(lines.occupied(frame), every, 80, counted=False)
    found, want = {(r.a, r.b) for r in left.collect()}, alike(texts)
    assert want and want <= found and len(found) < every.count() / 2
    assert {(r.a, r.b) for r in lines.verify(frame, left, 80).collect()} == want


def test_bands_name_the_coordinates_of_a_set(spark):
    texts = ["ab" * 30, "ab" * 45, "x", prose(random.Random(2), 60), "\U0001f600" * 4]
    frame = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    posted = lines.postings(frame)
    bands = {k: {r.band for r in posted.collect() if r.lid == k} for k in range(len(texts))}
    assert bands[0] == bands[1] and len(bands[3]) == lines.BANDS and len(bands[2]) == 1 and bands[4]
    assert not bands[0] & bands[3]


def test_a_line_is_one_group_and_lowered_once(spark):
    frame = spark.createDataFrame([(1, "Ab cd"), (2, None)], "doc_id long, text string")
    banded = plan(lines.postings(frame.selectExpr("doc_id AS lid", "text AS line")))
    assert "Aggregate [lid#" in banded and "band" not in banded.split("Aggregate [lid#")[1].split("]")[0]
    assert plan(lines.split_lines(frame)).count("lower(") == 1
