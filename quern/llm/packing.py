"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised with a public vocabulary and closed with id 0. Only a document longer than
``limit`` is cut, into pieces of ``limit`` of which the first takes the remainder; a full piece is a
sequence of its own. What is left, at most one piece a document, is packed in groups of about
``group_docs`` documents: best fit, as the pieces come, deals them to bins, then swap-based local search
exchanges one-for-one, two-for-one or moves pieces between underfull bins so that the sum of squared fills
grows and bins empty, until no exchange helps or the group's lower bound is met. Groups are dealt by a
hash and their number follows the number of documents, so a task's memory does not grow with the input,
and a group wastes less than one sequence against its bound in ordinary data.

Defined cases: null text is empty and gives the single id 0; repeated doc_ids and null doc_ids are packed
like any other row; strings that look like special tokens are ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, GROUP_DOCS, END_ID, DONORS = 2048, 32_768, 0, 8
# Ids travel as strings through pandas, which would turn a nullable long into a double.
SCHEMA = "doc_id string, piece int, start long, length long, ids_crc32 long"
_encoders: dict = {}


def encoder(vocabulary: str):
    """A function from text to its ids as little-endian uint32 bytes.

    ``vocabulary`` is the byte-level BPE of ``tokenizers`` (.json). Where the same vocabulary lies beside
    it as ranks (.tiktoken), the ids come from that file: they are the same, several times faster.
    """
    if vocabulary not in _encoders:
        try:
            import public_tokenizers
            import tiktoken

            with open(vocabulary.removesuffix("json") + "tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            _encoders[vocabulary] = lambda text: np.array(core.encode_ordinary(text), dtype="<u4").tobytes()
        except (ImportError, FileNotFoundError):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(vocabulary)
            own.encode_special_tokens = True
            _encoders[vocabulary] = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    return _encoders[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if isinstance(text, str) else b"") + end
                n = len(ids) // 4
                first = n % limit or limit
                for k, (a, b) in enumerate(pairwise([0, *range(first, n + 1, limit)])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, SCHEMA)


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins as lists of indexes into ``sizes``: each piece into the fullest bin that holds it, first those of half a bin or more, then the others as they come."""
    bins, by_room, mask = [], [[] for _ in range(limit + 1)], 0
    for i, size in sorted(enumerate(sizes), key=lambda x: 2 * x[1] < limit):
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = limit, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        mask |= 1 << (room - size)
    return bins


class _Reach:
    """Underfull bins by what would fill them: room alone (a move), or room and one piece that leaves (an exchange)."""

    def __init__(self, limit: int):
        self.turn, self.places = {}, [[] for _ in range(limit + 1)]

    def put(self, b: int, room: int, members: list[int], sizes: list[int]) -> None:
        self.turn[b] = turn = self.turn.get(b, 0) + 1  # what was said of the bin before holds no more
        if room and members:
            self.places[room].append((b, turn, ()))
            some = list({sizes[j]: j for j in members}.items())
            for k, (size, j) in enumerate(some):
                self.places[room + size].append((b, turn, (j,)))
                for more, j2 in some[k + 1 :]:
                    if room + size + more < len(self.places):
                        self.places[room + size + more].append((b, turn, (j, j2)))

    def take(self, size: int, donor: int, one: bool) -> tuple[int, tuple] | None:
        """A bin but the donor that pieces of ``size`` in all would fill to the limit, and what leaves it; two pieces only if ``one`` comes."""
        found, held, out = self.places[size], [], None
        while found and out is None:
            b, turn, back = found.pop()
            if self.turn[b] == turn:
                if b == donor or (len(back) > 1 and not one):
                    held.append((b, turn, back))
                else:
                    out = b, back
        found += held
        return out


def local_search(bins: list[list[int]], sizes: list[int], limit: int) -> list[list[int]]:
    """Exchange pieces between underfull bins while the sum of squared fills grows, emptying bins.

    The emptiest bin is the donor. One or two of its pieces go to a bin that they fill to the limit, by a move, or against one smaller
    piece, or one of them against two; where there is no such bin, the best exchange with the bin of the most room is made. Every exchange goes to a bin at
    least as full, so the sum grows. It ends at the lower bound, or when none of the emptiest bins, ``DONORS`` times as many as there
    are beyond the bound, has an exchange left.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    bound, alive = -(-sum(fill) // limit), sum(map(bool, bins))
    reach = _Reach(limit)
    for b, members in enumerate(bins):
        reach.put(b, limit - fill[b], members, sizes)
    moved = True
    while moved and alive > bound:  # a bin that had no exchange may have one once others have changed
        moved, stuck = False, set()
        queue = [(f, b) for b, f in enumerate(fill) if bins[b] and f < limit]
        heapq.heapify(queue)
        while alive > bound and queue and len(stuck) < DONORS * (alive - bound):
            f, donor = heapq.heappop(queue)
            if f != fill[donor] or not bins[donor] or donor in stuck or f == limit:
                continue
            while bins[donor]:
                other = _fill_up(bins, sizes, fill, donor, reach)
                if other is None and len(stuck) < alive - bound:
                    other = _improve(bins, sizes, fill, donor, limit)
                if other is None:
                    stuck.add(donor)
                    break
                moved = True
                reach.put(other, limit - fill[other], bins[other], sizes)
                heapq.heappush(queue, (fill[other], other))
            reach.put(donor, limit - fill[donor], bins[donor], sizes)
            alive -= not bins[donor]
    return [b for b in bins if b]


def _swap(bins, sizes, fill, donor: int, other: int, out: tuple, back: tuple) -> int:
    gain = sum(sizes[i] for i in out) - sum(sizes[j] for j in back)
    bins[donor] = [i for i in bins[donor] if i not in out] + list(back)
    bins[other] = [j for j in bins[other] if j not in back] + list(out)
    fill[donor], fill[other] = fill[donor] - gain, fill[other] + gain
    return other


def _fill_up(bins, sizes, fill, donor: int, reach: _Reach) -> int | None:
    """Fill another bin to the limit with one or two of the donor's pieces; the bin."""
    give = sorted({sizes[i]: i for i in bins[donor]}.items(), reverse=True)
    for size, i in give:
        if found := reach.take(size, donor, True):
            return _swap(bins, sizes, fill, donor, found[0], (i,), found[1])
    for x, (size, i) in enumerate(give):
        for more, i2 in give[x + 1 :]:
            if size + more < len(reach.places) and (found := reach.take(size + more, donor, False)):
                return _swap(bins, sizes, fill, donor, found[0], (i, i2), found[1])
    return None


def _improve(bins, sizes, fill, donor: int, limit: int) -> int | None:
    """The best exchange with the bin of the most room that has one; the bin."""
    others = sorted((b for b in range(len(bins)) if b != donor and bins[b] and fill[donor] <= fill[b] < limit), key=lambda b: (fill[b], b))
    for other in others:
        gain, out, back = _exchange(bins, sizes, donor, other, limit - fill[other])
        if gain:
            return _swap(bins, sizes, fill, donor, other, out, back)
    return None


def _exchange(bins, sizes, donor: int, other: int, room: int) -> tuple[int, tuple, tuple]:
    """The best single exchange from donor to other within room: the size that moves on balance, the pieces that go and that come."""
    give, take = bins[donor], bins[other]
    best = (0, (), ())
    have: dict[int, int] = {}
    for j in take:
        have.setdefault(sizes[j], j)
    for x, i in enumerate(give):
        if sizes[i] <= room:
            best = max(best, (sizes[i], (i,), ()))
        for s, j in have.items():
            if 0 < sizes[i] - s <= room:
                best = max(best, (sizes[i] - s, (i,), (j,)))
            for i2 in give[x + 1 :]:
                if 0 < sizes[i] + sizes[i2] - s <= room:
                    best = max(best, (sizes[i] + sizes[i2] - s, (i, i2), (j,)))
    return best


def pack_sizes(sizes: list[int], limit: int = LIMIT) -> list[list[int]]:
    return local_search(best_fit(sizes, limit), sizes, limit)


def pack(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text) with its sequence_id and offset."""
    groups = max(1, -(-docs.select("doc_id").count() // group_docs))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = group["length"].tolist()
        bins = pack_sizes(sizes, limit)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = b, at
                at += sizes[i]
        group["sequence_id"] = sequence + (int(group["group"].iloc[0]) << 32)
        group["offset"] = offset
        return group.drop(columns="group")

    cut = pieces(docs, vocabulary or default_vocabulary(), limit)
    # Equal rows share a hash, so a heavily repeated row is spread by its text's crc and start as well.
    keyed = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(groups)))
    placed = keyed.groupBy("group").applyInPandas(place, SCHEMA + ", sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))
