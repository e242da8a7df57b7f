"""Vectorised word and shingle hashes, shared by the operators that read whole texts.

A batch of texts is joined to one byte array; separators, word bounds and polynomial word hashes are
computed with numpy over the array, never word by word in Python. Memory is bounded: texts go through
in blocks of about ``BLOCK`` bytes (small enough for a core's cache), and a longer text is cut at a separator.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17
_WRAP = 4096


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = _rng.integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_POWER = np.multiply.accumulate(np.full(_WRAP, _ODD[0], dtype=np.uint64))

WHITE = np.zeros(256, dtype=bool)  # the separators of a word [^\x20\x09-\x0D]+
WHITE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = np.ones(256, dtype=bool)  # all ASCII but letters and digits
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _block(data: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~separator[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    value = _TABLE[raw[inside]]
    value *= _POWER[place & (_WRAP - 1)]
    if length.max() > _WRAP:  # the powers run on beyond the table
        far = np.flatnonzero(place >= _WRAP)
        turns = place[far] // _WRAP
        value[far] *= np.multiply.accumulate(np.full(turns.max(), _POWER[-1], dtype=np.uint64))[turns - 1]
    hashed = np.add.reduceat(value, first)
    hashed += length.astype(np.uint64) * _ODD[1]
    return _mix(hashed), start, end


def words(texts: list[bytes], separator: np.ndarray = WHITE, places: bool = False):
    """Word hashes of all texts in a row and the bounds of each text's own (one more than texts).

    With ``places`` also the byte offsets of every word's start and end in its text.
    """
    out, starts, ends, counts, k = [], [], [], [], 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) <= BLOCK):
            size, j = size + len(texts[j]) + 1, j + 1
        if size <= 2 * BLOCK:
            h, s, e = _block(b"\n".join(texts[k:j]), separator)
            at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[k:j]])))
            bound = np.searchsorted(s, at)
            count = np.diff(bound)
            counts.extend(count.tolist())
            out.append(h)
            if places:
                shift = np.repeat(at[:-1], count)
                starts.append(s - shift)
                ends.append(e - shift)
        else:  # one very long text, cut at separators
            total, at, text = 0, 0, texts[k]
            while at < len(text):
                to = min(len(text), at + BLOCK)
                while to < len(text) and not separator[text[to]]:
                    to += 1
                h, s, e = _block(text[at:to], separator)
                out.append(h)
                if places:
                    starts.append(s + at)
                    ends.append(e + at)
                total, at = total + len(h), to
            counts.append(total)
        k = j
    bounds = np.concatenate(([0], np.cumsum(np.asarray(counts, dtype=np.int64)))).astype(np.int64)
    joined = np.concatenate(out) if out else np.zeros(0, np.uint64)
    if not places:
        return joined, bounds
    none = np.zeros(0, np.int64)
    return joined, bounds, np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int):
    """An iterator of each text's k-word shingle hashes; of a shorter text the whole as one shingle."""
    n = len(hashes) - k + 1
    rows = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        rows += hashes[j : j + n] * _ODD[2 + j]
    rows = _mix(rows)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield rows[a : b - k + 1]
        elif b > a:
            yield _mix(np.add.reduce(hashes[a:b] * _ODD[2 : 2 + b - a], keepdims=True) + _ODD[40 + b - a : 41 + b - a])
        else:
            yield rows[:0]


class MinHash:
    """``size`` universal hash permutations x -> a*x + b of 32-bit shingle keys, with numpy."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = size
        self.a = (rng.integers(0, 2**31, size=(size, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
        self.b = rng.integers(0, 2**32, size=(size, 1), dtype=np.uint32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The signature of a set of uint64 hashes; all ones of an empty set."""
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        x = (keys >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(x), 2048):
            block = self.a * x[None, k : k + 2048]
            block += self.b
            np.minimum(low, block.min(axis=1), out=low)
        return low
