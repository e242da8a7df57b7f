"""Links between near copies that a band's smallest member does not show."""

import itertools
import random
import sys
from math import comb
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quern.llm import fingerprint, lines
from test_units import components, make, word_set


def changed(rng, words, n):
    at = set(rng.sample(range(len(words)), n))
    return [f"new{rng.random()}" if k in at else w for k, w in enumerate(words)]


def test_bands_link_members_that_their_smallest_does_not(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(changed(rng, base, 8)) for _ in range(60)] + [" ".join(changed(rng, base, 1)) for _ in range(3)]
    sets = [word_set(t, 5) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert (60, 61) in pairs and (60, 62) in pairs
    want = components(pairs, sorted({x for p in pairs for x in p}))
    assert {r.id: r.component_id for r in fingerprint.near_classes(make(spark, texts)).collect()} == want


def test_few_pairs_of_lines_are_lost_before_they_are_verified():
    lost = sum(comb(16, k) * 0.8**k * 0.2 ** (16 - k) for k in range(lines.ENOUGH))
    assert lost < 3e-4
