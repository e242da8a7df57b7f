"""Every stage of the pipeline on its predecessor's rows, against brute force."""

import itertools
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from quern.functions.storage import materialise
from test_units import components, edited, prose, word_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def build(spark, path):
    rng = random.Random(21)
    items = [prose(rng, 40, 3000) for _ in range(5)]
    base = [prose(rng, 80, 4000) for _ in range(40)]
    texts = list(base)
    texts += [base[0]] * 25 + [edited(rng, base[1], 0.02) for _ in range(10)]  # copies, whole and edited
    texts += [b + "\nAll rights reserved by nobody.\n" + prose(rng, 30, 4000) for b in (prose(rng, 50, 4000) for _ in range(8))]
    texts += [prose(rng, 60, 4000) + " " + edited(rng, items[i % 5], 0.1) for i in range(6)]
    junk = "".join(rng.choice("qxzjkvwp") for _ in range(500))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, junk, None, "s", 500), (901, None, "en", None, None), (902, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}


def test_stages(spark, tmp_path):
    texts = build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    after = {n: {r.doc_id: r.text for r in rows} for n, rows in seen.items() if n != "best_fit_packing"}

    assert set(after["language_id"]) == set(texts) - {900, 901, 902}
    assert all(after["language_id"][d] == texts[d] for d in after["language_id"])

    lines = [(d, n, x.strip(" ").lower()) for d, t in sorted(after["language_id"].items()) for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    distinct = sorted({x for *_, x in lines})
    sets = {x: {x[i : i + 10] for i in range(max(len(x) - 10, 0) + 1)} for x in distinct}
    comp = components([(a, b) for a, b in itertools.combinations(distinct, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], distinct)
    first = {}
    for d, n, x in lines:
        first.setdefault(comp[x], (d, n))
    gone = {(d, n) for d, n, x in lines if first[comp[x]] != (d, n)}
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in after["language_id"].items()}
    assert after["line_dedup"] == {d: t for d, t in want.items() if t.strip() or d not in {g for g, _ in gone}}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])

    shingled = {d: word_set(t, 5) for d, t in after["line_dedup"].items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(shingled), 2) if 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b])]
    assert set(after["near_dedup"]) == {d for d, c in components(links, sorted(shingled)).items() if c == d}

    held = range(83, 89)
    assert set(after["near_dedup"]) - set(after["benchmark_decontamination"]) == set(held) & set(after["near_dedup"])

    pieces = seen["best_fit_packing"]
    assert {r.doc_id for r in pieces} == set(after["benchmark_decontamination"])
    fills = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert fills.get(r.sequence_id, 0) == r.offset
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 2048

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))
