"""What a host's wrapper decides in op7."""

import random

from quern.llm import wrappers

PAGES = "page_id long, url string, html string"


def extracted(spark, pages):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, PAGES)).collect()}


def test_an_optional_string_at_its_own_place_is_template(spark):
    note = "<p>For members only</p><hr>"
    pages = [(i, "http://o.com/a", f"<div>{note if i % 3 else ''}<p>Story {i}</p></div>") for i in range(30)]
    got = extracted(spark, pages)
    assert all(got[i] == f"Story {i}" for i in range(30))


def test_a_string_of_the_template_is_main_text_where_it_stands_at_a_field(spark):
    pages = [(i, "http://p.com/a", f"<div><p>Go on</p></div><div><p>Story {i}</p>{'<p>Go on</p>' if i % 2 else ''}<p>End {i}</p></div>") for i in range(20)]
    got = extracted(spark, pages)
    assert all(got[i] == f"Story {i} {'Go on ' if i % 2 else ''}End {i}" for i in range(20))


def test_strings_that_differ_at_one_place_are_a_field(spark):
    pages = [(i, "http://q.com/a", f"<div><b>By</b></div><div>{'Staff' if i % 3 else f'Guest {i}'}</div><section>Story {i}</section>") for i in range(30)]
    got = extracted(spark, pages)
    assert all(got[i] == f"{'Staff' if i % 3 else f'Guest {i}'} Story {i}" for i in range(30))


def test_every_skeleton_takes_part(spark):
    rng = random.Random(2)
    parts = ["<h2>{0}</h2>", "<ul><li>{0}</ul>", "<table><tr><td>{0}</table>", "<pre>{0}</pre>", "<blockquote>{0}</blockquote>"]
    pages, want = [], []
    for i in range(120):
        some = [(rng.choice(parts), f"w{i}x{k}") for k in range(rng.randint(1, 6))]
        body = "".join(p.format(t) for p, t in some)
        pages.append((i, "http://r.com/a", f"<main><div>Read this first</div>{body}<div>Share it</div></main>"))
        want.append(" ".join(t for _, t in some))
    got = extracted(spark, pages)
    assert [got[i] for i in range(120)] == want
    streams = wrappers.read_pages(spark.createDataFrame(pages, PAGES)).select("host", "skeleton").distinct()
    assert streams.count() > 2 * wrappers.MERGED and wrappers.wrappers(streams).count() == 1


def test_a_wrapper_covers_its_pages():
    rng = random.Random(1)
    groups = [("p", "#a", "/p"), ("p", "=1#a", "/p"), ("h", "#b", "/h"), ("s", "h", "=1#b", "/h", "p", "#a", "/p", "/s"), ("hr",)]
    for _ in range(300):
        pages = [[t for _ in range(rng.randint(1, 7)) for t in rng.choice(groups)] for _ in range(rng.randint(2, 6))]
        half = len(pages) // 2
        steps = wrappers.program(wrappers.settled(wrappers.infer([wrappers.infer(pages[:half]), wrappers.infer(pages[half:])])))
        for page in pages:
            # A string that the program has nowhere ends the page only where the page before it is covered.
            assert wrappers.template_places([*steps, "=end#"], [*page, "=end#"])[-1:] == [len(page)]
