"""Arrays of fixed size that are added up over all rows on the executors: count sketches and bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAP_BITS = 24


def _packed(block: np.ndarray) -> bytes:
    """A block's cells: only the set ones with their places, where they are fewer bytes."""
    at = np.flatnonzero(block)
    if len(at) * (2 + block.itemsize) < block.nbytes:
        return at.astype("<u2").tobytes() + block[at].tobytes()
    return block.tobytes()


def _unpacked(part: bytes, step: int, dtype: np.dtype):
    """The places and values of a packed block."""
    if len(part) == step * dtype.itemsize:
        return slice(None), np.frombuffer(part, dtype)
    n = len(part) // (2 + dtype.itemsize)
    return np.frombuffer(part, "<u2", n), np.frombuffer(part[2 * n :], dtype)


def add_up(df: DataFrame, cells, n: int, dtype: str, combine=np.add) -> np.ndarray:
    """An array of ``n`` cells that ``cells(array, batch)`` fills, combined over all rows by blocks on the executors."""
    step = min(n, 1 << 14)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.dtype(dtype))
        for batch in batches:
            cells(total, batch)
        filled = [(k // step, _packed(total[k : k + step])) for k in range(0, n, step) if total[k : k + step].any()]
        yield pd.DataFrame(filled, columns=["block", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.dtype(dtype))
        for part in group["part"]:
            at, values = _unpacked(part, step, np.dtype(dtype))
            total[at] = combine(total[at], values)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "part": [total.tobytes()]})

    schema = "block long, part binary"
    out = np.zeros(n, np.dtype(dtype))
    for row in df.mapInPandas(partial, schema).groupBy("block").applyInPandas(add, schema).collect():  # n cells, whatever the input
        out[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(row["part"], np.dtype(dtype))
    return out


def _cell(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of 2**MAP_BITS bits (2 MB, whatever the input) of the long column ``key``.

    It only decides which rows are worth a second look: a false hit costs time, never a result.
    """

    def cells(total, batch):
        total[_cell(batch["key"].to_numpy())] = 1

    return np.packbits(add_up(keys.select("key"), cells, 1 << MAP_BITS, "uint8", np.maximum) > 0)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = _cell(keys)
    return ((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
