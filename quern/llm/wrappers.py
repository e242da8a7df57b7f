"""HTML extraction by wrappers: same-host skeletons aligned to a union-free regular expression.

Every text of a page stands in a slot, the path of its block elements. A slot's role follows from its path: main text,
or menu, header, footer, sidebar, notice, advert, form, script, style or reader comment; outside of an article or main
element nothing is main text on a page that has one. Roles depend on the page alone, and a page's skeleton is the tags
and blocks of text of its main part.

A host's skeletons are aligned to one expression of tags, strings, fields (``#`` and a path), optional parts and repeated
groups. A block of text stands as a string in the skeleton if at least half of the host's pages and ``LEAST_PAGES`` of them have it in
that slot (pages counted once for each distinct main text, all of them), and as a field otherwise. Alignment goes by equal nodes, then,
between those, by nodes that are equal but for their strings: strings that differ at one place of the expression, or a string and a field, are a field; so is a
string between repetitions of a group, or in an optional part that repeats the group beside it. What is left as a
string is the host's template: each page is matched to the expression, and a block that stands at a string is taken
away. A block at a field is main text, also where it equals a string of the template elsewhere on the page.

Pages are parsed twice, for the counts and for the blocks. Every distinct skeleton takes part: they are aligned in chunks of about ``MERGED``, and
the chunks' expressions again until a host has one, so a hot host is no hot task; a row holds the expressions of a chunk.
Strings, expressions and the positions to leave out are broadcast while smaller than ``BROADCAST_BYTES``, and joined by key beyond.

Defined cases: null html is empty; a page without text in main slots gives the empty text; unclosed and cut tags end
with the page; a bare ``&`` and unknown references stay as they are; pages with a null url share the host ''; repeated
pages each give a row and count once; a page of nothing but its host's template gives the empty text.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.storage import materialise
from quern.llm.urlrules import split_url

LONGEST_UNIT, LEAST_PAGES, BROADCAST_BYTES = 16, 5, 32 << 20
MERGED = 16  # expressions aligned in a row
TEXT, STRING = "#", "="
# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template svg textarea title iframe object select math canvas audio video".split())
ASIDE = set("nav header footer aside form menu button head dialog fieldset option".split())
MAIN = set("article main".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}
ASIDE_WORDS = re.compile(
    r"(?i)(?<![a-z])(ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|sidebar|side-?bar|comments?|disqus|"
    r"replies|respond|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|pagination)(?![a-z])")
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*\Z|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag name, rest) in page order: 'open', 'close' and 'text'; comments and raw elements are left out."""
    at = 0
    while at < len(page):
        m = _PIECE.match(page, at)
        if m is None:  # a tag whose quote never closes
            return
        at = m.end()
        name = m.group(2)
        if name is None:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                yield "text", "", m.group()
            continue
        name = name.lower()
        if m.group(1):
            yield "close", name, ""
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        yield "open", name, m.group(3)


def slots(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(token, text, breaks, slot): every tag as a token and every run of text as its slot; a tag's slot is the one it stands in, itself included.

    A slot is ``#`` and the path of its block elements with the class words that mark asides.
    """
    stack: list[tuple[str, str]] = []  # name and slot
    for kind, name, rest in pieces(page):
        here = stack[-1][1] if stack else TEXT
        if kind == "text":
            yield here if rest.strip() else "", rest, False, here
            continue
        if kind == "open":
            if name in CLOSES_P:
                _close(stack, "p", {"table", "button"})
            if name in CLOSES_ITSELF:
                _close(stack, name, CLOSES_ITSELF[name])
            words = " ".join(x for found in _NAMES.findall(rest) for x in found if x) if rest else ""
            label = f"{name}.aside" if words and ASIDE_WORDS.search(words) else name
            here = stack[-1][1] if stack else TEXT
            if name not in INLINE:
                here = f"{here}/{label}" if here != TEXT else TEXT + label
            if name not in VOID and not rest.endswith("/"):
                stack.append((name, here))
            yield label, None, name not in INLINE, here
        else:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            yield "/" + name, None, name not in INLINE, here


def _close(stack: list[tuple[str, str]], name: str, limits: set[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == name:
            del stack[k:]
            return
        if stack[k][0] in limits or stack[k][0] not in INLINE | {"p", name}:
            return


Node = str | tuple[str, tuple]


def fold(stream: list[Node], units: set[tuple] = frozenset()) -> list[Node]:
    """Immediate repetitions become ('+', unit); a single copy of a unit in ``units`` does too."""
    out: list[Node] = []
    k = 0
    while k < len(stream):
        for size in range(1, min(LONGEST_UNIT, len(stream) - k) + 1):
            unit = tuple(stream[k : k + size])
            times = 1
            while stream[k + times * size : k + (times + 1) * size] == list(unit):
                times += 1
            if times > 1 or unit in units:
                if not (out and out[-1] == ("+", unit)):
                    out.append(("+", unit))
                k += times * size
                break
        else:
            out.append(stream[k])
            k += 1
    return out


def _units(nodes: list[Node]) -> set[tuple]:
    found: set[tuple] = set()
    for n in nodes:
        if isinstance(n, tuple):
            found |= _units(n[1])
            if n[0] == "+":
                found.add(n[1])
    return found


def general(node: Node) -> Node:
    """The node with a field for every string."""
    if isinstance(node, tuple):
        return node[0], tuple(map(general, node[1]))
    return node[node.index(TEXT) :] if node.startswith(STRING) else node


def _between(nodes: list[Node]) -> list[Node]:
    """``nodes`` with fields for the strings that stand between repetitions of a group."""
    plain, out = [general(n) for n in nodes], list(nodes)
    if plain == out:
        return out
    for size in range(1, LONGEST_UNIT + 1):
        for k in range(len(out)):
            unit = plain[k][1] if isinstance(plain[k], tuple) and plain[k][0] == "+" and len(plain[k][1]) == size else tuple(plain[k : k + size])
            if len(unit) < size or not any(isinstance(n, str) and n.startswith(TEXT) for n in unit):
                continue
            at, last = k, None
            while True:  # the copies of the unit from k on; the first and the last of them without strings bound what is between
                step = 1 if at < len(plain) and plain[at] == ("+", unit) else size if tuple(plain[at : at + size]) == unit else 0
                if not step:
                    break
                if out[at : at + step] == plain[at : at + step]:
                    last = at
                elif at == k:
                    break
                at += step
            if last is not None and last > k:
                out[k:last] = plain[k:last]
    return out


def folded(stream: list[Node], units: set[tuple] = frozenset()) -> list[Node]:
    """Folds until groups of groups are found too."""
    while True:
        found = _between(fold(stream, units | _units(stream)))
        if found == stream:
            return found
        stream = found


def _bare(node: Node) -> tuple[Node, bool]:
    optional = False
    while isinstance(node, tuple) and node[0] == "?" and len(node[1]) == 1:
        node, optional = node[1][0], True
    return node, optional


def _joined(x: Node, y: Node) -> Node:
    """One node for two that are equal but for their strings."""
    if x == y:
        return x
    return (x[0], tuple(map(_joined, x[1], y[1]))) if isinstance(x, tuple) else general(x)


def _merged(one: list[tuple[Node, bool]], two: list[tuple[Node, bool]], exact: bool = True) -> list[Node]:
    keys = [[n if exact else general(n) for n, _ in side] for side in (one, two)]
    out: list[Node] = []
    for op, a, b, c, d in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if op == "equal":
            for (x, p), (y, q) in zip(one[a:b], two[c:d], strict=True):
                out.append(("?", (_joined(x, y),)) if p or q else _joined(x, y))
        elif op == "replace" and exact:
            out.extend(_merged(one[a:b], two[c:d], False))
        else:
            out.extend(("?", (n,)) for n, _ in one[a:b] + two[c:d])
    return out


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper generalised so that it also covers the other expression, or a page's stream."""
    units = _units(wrapper) | _units(page)
    return _merged(*([_bare(n) for n in folded(side, units)] for side in (wrapper, page)))


def infer(streams: list[list[Node]]) -> list[Node]:
    """The wrapper of all streams, aligned in the order given."""
    wrapper = folded(streams[0])
    for stream in streams[1:]:
        wrapper = align(wrapper, folded(stream))
    return wrapper


def settled(wrapper: list[Node]) -> list[Node]:
    """The wrapper with fields for the strings of optional parts that repeat the group beside them."""
    out = list(wrapper)
    bare = [_bare(n) for n in wrapper]
    for k, (group, _) in enumerate(bare):
        if not (isinstance(group, tuple) and group[0] == "+"):
            continue
        unit, size = list(general(group)[1]), len(group[1])
        for step in (1, -1):
            at = k + 1 if step > 0 else k - size
            while 0 <= at and at + size <= len(bare) and all(o for _, o in bare[at : at + size]) and [general(n) for n, _ in bare[at : at + size]] == unit:
                out[at : at + size] = map(general, out[at : at + size])
                at += step * size
    return out


def program(wrapper: list[Node]) -> list[str | tuple[int, int]]:
    """The wrapper as tokens and jumps; a jump names two places, the preferred one first."""
    steps: list = []

    def add(nodes) -> None:
        for n in nodes:
            start = len(steps)
            if not isinstance(n, tuple):
                steps.append(n)
            elif n[0] == "?":
                steps.append(())
                add(n[1])
                steps[start] = (start + 1, len(steps))
            else:
                add(n[1])
                steps.append((start, len(steps) + 1))

    add(wrapper)
    return steps


def template_places(steps: list[str | tuple[int, int]], stream: list[str]) -> list[int]:
    """The positions of ``stream`` that stand at a string of the program, as many as can; none if it does not cover the stream."""
    plain, end = [general(t) for t in stream], (len(steps), len(stream))
    seen: set[tuple[int, int]] = set()
    now, later = [(0, 0, None)], []  # later: one string more that stands at a field
    while now or later:
        if not now:
            now, later = later[::-1], []
        step, at, trail = now.pop()
        if (step, at) in seen:
            continue
        seen.add((step, at))
        if (step, at) == end:
            found = []
            while trail:
                place, trail = trail
                found.append(place)
            return found[::-1]
        if step == len(steps):
            continue
        want = steps[step]
        if isinstance(want, tuple):
            now += [(want[1], at, trail), (want[0], at, trail)]
        elif at < len(stream):
            if want == stream[at]:
                now.append((step + 1, at + 1, (at, trail) if want.startswith(STRING) else trail))
            elif want == plain[at]:
                later.append((step + 1, at + 1, trail))
    return []


def text_slots(nodes) -> set[str]:
    found = set()
    for n in nodes:
        if isinstance(n, tuple):
            found |= text_slots(n[1])
        elif n.startswith(TEXT):
            found.add(n)
    return found


@lru_cache(1 << 14)
def is_main(slot: str, has_main: bool) -> bool:
    """The role of a text slot from its path; ``has_main``: the page has an article or main element."""
    path = slot[len(TEXT) :].split("/")
    tags = [p.partition(".")[0] for p in path]
    inside = max((k for k, t in enumerate(tags) if t in MAIN), default=None)
    if has_main and inside is None:
        return False
    start = 0 if inside is None else inside + 1
    return not any(p.endswith(".aside") or t in ASIDE for p, t in zip(path[start:], tags[start:], strict=True)) and not any(
        t in ASIDE - {"header"} or p.endswith(".aside") for p, t in zip(path[:start], tags[:start], strict=True))


def main_stream(page: str) -> Iterator[tuple[str, str | None]]:
    """(tag, None) and (slot, text) of the block tags and blocks of text of the main part, in page order; the page itself says whether it has a main element."""
    parts = list(slots(page))
    has_main = any(t in MAIN for t, x, _, _ in parts if x is None)
    current, slot = [], ""

    def block() -> str:
        return " ".join(references.unescape("".join(current)).split())

    for token, text, breaks, here in parts:
        if text is None:
            if breaks:
                if current:
                    if found := block():
                        yield slot, found
                    current = []
                if is_main(here, has_main):
                    yield token, None
            continue
        if not token:
            if current:
                current.append(text)
            continue
        if is_main(token, has_main):
            current.append(text)
            slot = token
    if found := block():
        yield slot, found


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def common_strings(pages: DataFrame) -> DataFrame:
    """host and same (numbers of the main blocks that half of its pages and ``LEAST_PAGES`` have) of ``pages`` (host, html) for hosts that have any."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [b for b in main_stream(page) if b[1] is not None] if page else []
                if found:
                    one = _number(*(x for block in found for x in block))
                    seen.add((host, None, one))
                    seen |= {(host, _number(slot, text), one) for slot, text in found}
            columns = list(zip(*seen, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "block", "page"])

    found = pages.select("host", "html").mapInArrow(sketch, "host long, block long, page long").distinct()
    counts = materialise(found.groupBy("host", "block").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES), "blocks")
    hosts = counts.filter("block IS NULL").select("host", F.col("n").alias("n_host"))
    return counts.filter("block IS NOT NULL").join(hosts, "host").filter("2 * n >= n_host").groupBy("host").agg(F.collect_list("block").alias("same"))


def _small(frame: DataFrame, width) -> DataFrame:
    """``frame`` to be broadcast, if its rows of ``width`` bytes are few enough."""
    return F.broadcast(frame) if (frame.agg(F.sum(width)).first()[0] or 0) < BROADCAST_BYTES else frame


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks of every row; skeleton (tokens of the main part, blank between them), null without a main part."""
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(split_url(F.col("url"))[0]).alias("host"))
    same = materialise(common_strings(split), "strings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skeletons, blocks = [], []
            for page, same in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = list(main_stream(page)) if page else []
                blocks.append([text for _, text in found if text is not None])
                skeletons.append(None)
                if found:
                    strings = frozenset(same or ())
                    numbers = [text if text is None else _number(token, text) for token, text in found]
                    skeletons[-1] = " ".join(f"{STRING}{n}{token}" if n in strings else token for (token, _), n in zip(found, numbers, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(skeletons, pa.string()), pa.array(blocks, pa.list_(pa.string()))], names=["page_id", "url", "host", "skeleton", "blocks"])

    joined = split.join(_small(same, 16 + 8 * F.size("same")), "host", "left")
    return joined.select("page_id", "url", "host", "html", "same").mapInArrow(run, "page_id long, url string, host long, skeleton string, blocks array<string>")


def wrappers(streams: DataFrame) -> DataFrame:
    """host and wrapper (as JSON) of ``streams`` (host, skeleton): chunks of a host's expressions are aligned until there is one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(infer([_read(x) for x in chunk])) for chunk in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    parts = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = streams.select("host", F.to_json(F.split("skeleton", " ")).alias("wrapper"))
    while True:
        counts = level.groupBy("host").agg(F.count("*").alias("n"))
        dealt = level.join(counts, "host").withColumn("chunk", F.expr(f"pmod(xxhash64(wrapper), CAST(ceil(n / {MERGED}) AS INT))"))
        # By number: an alignment is much work for few bytes, so parts are not to be put together by size.
        chunks = dealt.repartition(parts, "host", "chunk").groupBy("host", "chunk").agg(F.sort_array(F.collect_list("wrapper")).alias("wrappers"))
        level = materialise(chunks.select("host", "wrappers").mapInArrow(merge, "host long, wrapper string").distinct(), "wrappers")
        if level.groupBy("host").count().filter("count > 1").isEmpty():
            return level


def _read(text: str) -> list[Node]:
    def node(x) -> Node:
        return x if isinstance(x, str) else (x[0], tuple(map(node, x[1])))

    return [node(x) for x in json.loads(text)]


def template_blocks(streams: DataFrame) -> DataFrame:
    """host, skeleton, gone (the numbers, from 0, of the blocks that stand at a string of the host's wrapper) of the skeletons with such blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, list] = (None, [])
        for batch in batches:
            gone = []
            for skeleton, wrapper in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if known[0] != wrapper:
                    known = (wrapper, program(settled(_read(wrapper))))
                stream = skeleton.split(" ")
                number = {place: k for k, place in enumerate(p for p, t in enumerate(stream) if t[0] in (TEXT, STRING))}
                gone.append([number[place] for place in template_places(known[1], stream)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(gone, pa.list_(pa.int32()))], names=["host", "skeleton", "gone"])

    made = wrappers(streams)
    parts = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = streams.repartition(parts).join(_small(made, 16 + F.length("wrapper")), "host")
    return joined.select("host", "skeleton", "wrapper").mapInArrow(run, "host long, skeleton string, gone array<int>").filter("size(gone) > 0")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    read = materialise(read_pages(pages), "page-blocks")
    streams = materialise(read.filter("skeleton IS NOT NULL").select("host", "skeleton").distinct(), "skeletons")
    gone = materialise(template_blocks(streams), "template")
    joined = read.join(_small(gone, 16 + F.length("skeleton") + 4 * F.size("gone")), ["host", "skeleton"], "left")
    left = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda x, i: ~F.array_contains("gone", i)))
    return joined.select("page_id", "url", F.array_join(left, " ").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
