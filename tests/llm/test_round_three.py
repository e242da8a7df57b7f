"""Cases of the third round: growth, thresholds from all texts, the method itself."""

import itertools
import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quern.llm import langid, lines
from test_units import components, prose


def test_visits_of_blocks_stay_below_the_square_of_a_bucket(spark):
    held = spark.range(1024).selectExpr("1L AS band", "CAST(id % 4 AS INT) * 2 AS k", "false AS inside", "CAST(id / 4 AS INT) AS block", "256 AS blocks", "array(id) AS lines")
    left, right = lines._dealt(held)
    assert left.count() == 1024 and right.count() == 4 * 256 * 16  # 1024 * 128 where all blocks visit every eighth's share


def test_pairs_are_found_between_classes_and_blocks(spark, monkeypatch):
    rng = random.Random(19)
    shared = prose(rng, 30)
    texts = sorted({f"{shared} {prose(rng, rng.choice((3, 6, 12, 25, 50)), 10**6)}" for _ in range(300)})
    texts += [t + "." for t in texts[::20]]
    frame = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    label = frame.selectExpr("explode(array(1L, 2L, 3L)) AS band", "lid", "lid AS c")
    monkeypatch.setattr(lines, "BLOCK_LINES", 8)
    monkeypatch.setattr(lines, "DEALT_BLOCKS", 2)
    sets = [{x[i : i + 10] for i in range(max(len(x) - 10, 0) + 1)} for x in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert pairs and components([(r.a, r.b) for r in lines.block_links(frame, label, 80).collect()], range(len(texts))) == components(pairs, range(len(texts)))


def test_few_pairs_of_lines_share_no_band():
    assert (1 - 0.8**lines.ROWS) ** lines.BANDS < 2.8e-4


def test_rejection_limits_come_from_all_texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghij"[: 2 + i % 9]) for _ in range(60)), "xy"[i % 2]) for i in range(1001)] + [(2000, "ab", "x"), (2001, None, "x"), (2002, "abab" * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_model(docs)
    scores = [r for r in langid.scored(docs.filter("doc_id < 1001"), model).collect()]
    for c, lang in enumerate("xy"):
        ce = np.array([-r["_sums"][c] / r["_n"] for r in scores if r.lang == lang])
        assert abs(model.mean[c] - np.median(ce)) < 1e-9
        assert abs(model.spread[c] - max(1.4826 * np.median(np.abs(ce - np.median(ce))), 0.02)) < 1e-9
