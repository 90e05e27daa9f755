"""Count-min sketches of 64-bit hashes: one partial sketch per task, merged by segment, read back as bit tables.

Partial sketches are sparse lists of cells, so what a task sends grows with what it has read; each segment is merged on
its own and only the bits "count reached `at_least`" travel on. Their size is fixed by `bits` alone, which bounds what is
broadcast. A test never misses a hash whose true count reached the limit; collisions only add false positives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH = 2
SEGMENTS = 128
_ODD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def bits_for(items: int, *, per_item: int = 6, least: int = 16, most: int = 29) -> int:
    """Cells as a power of two: about `per_item` for each item, within bounds (2**29 cells are 64 MB a row)."""
    return min(most, max(least, math.ceil(math.log2(max(1, items) * per_item))))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(_ODD[row])) >> np.uint64(64 - bits)).astype(np.int64)


def packed(cells: np.ndarray) -> bytes:
    """Sorted cells as steps: a byte under 255 ends a step, each 255 lengthens it."""
    steps = np.diff(cells, prepend=0)
    whole = steps // 255
    out = np.full(int(whole.sum()) + len(steps), 255, dtype=np.uint8)
    out[np.cumsum(whole + 1) - 1] = steps % 255
    return out.tobytes()


def unpacked(data) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


class Bits:
    """The merged bit tables."""

    def __init__(self, rows: list[np.ndarray], bits: int):
        self.rows, self.bits = rows, bits

    def test(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for r, table in enumerate(self.rows):
            cell = _cells(hashes, r, self.bits)
            found &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return found


def build(
    df: DataFrame,
    hashes_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, int]]],
    *,
    bits: int,
    at_least: int,
    flush: int = 1_000_000,
) -> Bits:
    """Sketch (hashes, weight) arrays of every batch of `df`; bits are set where the summed weight reaches `at_least`."""
    size = (1 << bits) // SEGMENTS

    def partial(batches):
        held: list[tuple[np.ndarray, int]] = []
        n = 0

        def send():
            rows, segs, cells = [], [], []
            for r in range(DEPTH):
                own = np.concatenate([np.repeat(_cells(h, r, bits), min(w, at_least)) for h, w in held])
                own.sort()
                # beyond at_least occurrences of a cell nothing more can be learnt from this task
                if len(own) > at_least:
                    own = own[np.concatenate([np.ones(at_least, bool), own[at_least:] != own[:-at_least]])]
                cut = np.searchsorted(own, np.arange(SEGMENTS + 1) * size)
                for s in range(SEGMENTS):
                    if cut[s + 1] > cut[s]:
                        rows.append(r)
                        segs.append(s)
                        cells.append(packed(own[cut[s] : cut[s + 1]] - s * size))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(segs, pa.int32()), pa.array(cells, pa.binary())],
                names=["r", "s", "cells"],
            )

        for batch in batches:
            for h, w in hashes_of(batch):
                if len(h):
                    held.append((h, w))
                    n += len(h)
                if n >= flush:
                    yield send()
                    n = 0
        if held:
            yield send()

    def merge(key, table):
        seen = np.zeros(size, dtype=np.uint8)
        for c in table["cells"]:
            cell, count = np.unique(unpacked(c.as_buffer()), return_counts=True)
            seen[cell] = np.minimum(seen[cell] + count, at_least)
        packed = np.packbits(seen >= at_least).tobytes()
        return pa.table(
            {"r": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([key[1].as_py()], pa.int32()), "b": [packed]},
            schema=pa.schema([("r", pa.int32()), ("s", pa.int32()), ("b", pa.binary())]),
        )

    parts = df.mapInArrow(partial, "r int, s int, cells binary")
    merged = parts.groupBy("r", "s").applyInArrow(merge, "r int, s int, b binary")
    rows = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(DEPTH)]
    for x in merged.toLocalIterator():  # a partition at a time, so the driver never holds a second copy
        at = x["s"] * size // 8
        rows[x["r"]][at : at + size // 8] = np.frombuffer(x["b"], dtype=np.uint8)
    return Bits(rows, bits)
