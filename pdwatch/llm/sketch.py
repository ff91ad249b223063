"""A count-min sketch of a corpus: partitions count on their own, slices of the sketch are merged by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pdwatch.llm.common import expanded, squeezed
from pdwatch.session import settle

#: Counter rows. A key is counted in one cell of each, and the smallest of them bounds its count from above.
ROWS = 2
SLICE_BITS = 20
#: A sketch has about one cell per key and row, in these limits. The upper one bounds what is broadcast (ROWS bitmaps of
#: 2^29 bits for each level); beyond it more keys are overestimated, and none is underestimated.
LEAST_BITS, MOST_BITS = 20, 29

_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
SCHEMA = "row int, slice int, cells binary"


def bits_for(keys: int) -> int:
    return min(max(int(keys).bit_length(), LEAST_BITS), MOST_BITS)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order. A short array is sorted faster than it is put into a table of hashes, as `np.unique` does."""
    ordered = np.sort(keys)
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(32))) * _MIX[row]
    return (mixed >> np.uint64(64 - bits)).astype(np.uint32)


def partial(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pd.DataFrame]:
    """The sketch of some distinct keys, as rows of SCHEMA: the filled cells of each slice and their counts."""
    found = []
    least = np.minimum(counts, 255).astype(np.uint64)
    for row in range(ROWS):
        # Cells with their counts as one number each: plain numbers sort many times faster than positions.
        sorted_cells = np.sort(_cells(keys, row, bits).astype(np.uint64) << np.uint64(8) | least)
        cells, held = (sorted_cells >> np.uint64(8)).astype(np.uint32), sorted_cells.astype(np.uint8)
        slices = cells >> np.uint32(SLICE_BITS)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(slices)) + 1, [len(cells)]]) if len(cells) else []
        for start, end in zip(cuts[:-1], cuts[1:], strict=False):
            low = cells[start:end] & np.uint32((1 << SLICE_BITS) - 1)
            gaps = np.diff(low, prepend=np.uint32(0)).astype("<u4")
            # One plane per byte: the upper planes are almost all zero and vanish when compressed.
            planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes()
            found.append((row, int(slices[start]), squeezed(planes + held[start:end].tobytes())))
    yield pd.DataFrame(found, columns=["row", "slice", "cells"])


def _merge(levels: list[int]):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << SLICE_BITS, np.uint32)
        for blob in group["cells"]:
            data = np.frombuffer(expanded(blob), np.uint8)
            size = len(data) // 5
            gaps = np.ascontiguousarray(data[: 4 * size].reshape(4, size).T).view("<u4").ravel()
            np.add.at(total, np.cumsum(gaps, dtype=np.int64), data[4 * size :])
        bitmaps = b"".join(np.packbits(total >= level).tobytes() for level in levels)
        return pd.DataFrame({"row": group["row"].iloc[:1], "slice": group["slice"].iloc[:1], "cells": [bitmaps]})

    return merge


def merged(partials: DataFrame, bits: int, levels: list[int]) -> list[list[np.ndarray]]:
    """For each level and row, the bitmap of the cells that count at least so much."""
    # Written first: a local iterator computes one partition after the other.
    rows = settle(partials.groupBy("row", "slice").applyInPandas(_merge(levels), SCHEMA), "sketch")
    width = (1 << SLICE_BITS) // 8
    bitmaps = [[np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)] for _ in levels]
    for row, number, data in rows.toLocalIterator():
        for level in range(len(levels)):
            part = np.frombuffer(data, np.uint8, width, level * width)
            bitmaps[level][row][number * width : (number + 1) * width] = part
    return bitmaps


def at_least(keys: np.ndarray, bitmaps: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether each key's estimate reaches the level of the bitmaps. True for every key that truly does."""
    found = np.zeros(len(keys), bool)
    at = np.arange(len(keys))
    for row, bitmap in enumerate(bitmaps):
        # The next row is asked only about keys that this one lets through.
        cells = _cells(keys if row == 0 else keys[at], row, bits)
        at = at[(bitmap[cells >> np.uint32(3)] >> (7 - (cells & np.uint32(7))).astype(np.uint8) & 1).astype(bool)]
    found[at] = True
    return found
