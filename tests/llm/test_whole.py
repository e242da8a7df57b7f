"""Cases where an operator once did less than its whole job."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quern.llm import langid, lines, wrappers

PAGES = "page_id long, url string, html string"


def extracted(spark, pages):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, PAGES)).collect()}


def test_pages_without_article_keep_their_text_on_a_mixed_host(spark):
    pages = [(i, "http://m.com/a", f"<article>{'<h2>T</h2><p>x</p>' * i}<ul><li>word {i}</ul></article>") for i in range(60)]
    pages += [(100 + i, "http://m.com/b", f"<div><p>whole text {i}</p></div>") for i in range(3)]
    got = extracted(spark, pages)
    assert [got[100 + i] for i in range(3)] == [f"whole text {i}" for i in range(3)]
    assert all(got[i].endswith(f"word {i}") for i in range(60))


def test_text_that_a_host_repeats_is_template(spark):
    pages = [(i, "http://n.com/a", f"<div><p>Home News Sports</p></div><div><span>Subscribers only</span></div><section><p>Story {i}</p></section>") for i in range(20)]
    pages += [(50 + i, "http://copies.com", "<div>One article, often crawled</div>") for i in range(9)]
    pages += [(70, "http://rare.com", "<div>Home News Sports</div>")]
    got = extracted(spark, pages)
    assert all(got[i] == f"Story {i}" for i in range(20))
    assert {got[50 + i] for i in range(9)} == {"One article, often crawled"} and got[70] == "Home News Sports"


def test_rows_of_one_doc_id_lose_lines_by_content(spark):
    rows = [(1, "a line that stands elsewhere too"), (None, "a line that stands elsewhere too\nown line of the second"), (None, "nobody else has this line"),
            (7, "a line that stands elsewhere too\nfirst of seven"), (7, "second row of seven\nits other line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text for r in lines.dedup_lines(docs).collect())
    assert got == sorted(["a line that stands elsewhere too", "own line of the second", "nobody else has this line", "first of seven", "second row of seven\nits other line"])
    assert lines.line_classes(docs).columns == ["doc_id", "line_no", "kept", "first_doc_id", "first_line_no"]


def test_language_models_hold_every_gram_in_any_number_of_parts(spark, monkeypatch):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    rows = [(i, "".join(rng.choice(letters[: 300 + 300 * (i % 2)]) for _ in range(4000)), "ab"[i % 2]) for i in range(120)]
    rows += [(500, None, None), (501, "", None), (502, "zzz " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.filter("doc_id < 120")
    seen = train.transform(langid.gram_counts).filter("lang = 'a'").count()
    assert seen > 200_000
    got = []
    for size in (1 << 40, 8 << 20):
        monkeypatch.setattr(langid, "MODEL_BYTES", size)
        model = langid.train_model(train)
        if size == 1 << 40:
            assert model.size == 1 and len(model.model(0).grams[4].hashes) > 400_000
        else:
            assert model.size > 1
        got.append({r.doc_id: r for r in langid.predict(docs, model).collect()})
    for i, r in got[0].items():
        other = got[1][i]
        assert (r.lang_pred, r.rejected) == (other.lang_pred, other.rejected)
        assert abs(r.cross_entropy - other.cross_entropy) < 1e-5 and abs(r.score - other.score) < 1e-4


def test_calibration_reads_whole_texts(spark):
    rng = random.Random(4)
    rows = [(i, "ab " * 7000 + "".join(rng.choice("cdefghij ") for _ in range(60_000)), "a") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_model(docs)
    whole = [r.cross_entropy for r in langid.predict(docs, model).collect()]
    assert abs(model.mean[0] - sorted(whole)[1]) < 1e-9
