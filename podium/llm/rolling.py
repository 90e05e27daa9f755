"""Vectorised hashing of words and windows over the bytes of many texts at once (numpy inside Spark tasks).

A text's bytes are mapped through a fixed table of random 64-bit values and summed as a polynomial modulo 2**64, so the
hash of any byte range is one subtraction of prefix sums. Word hashes are byte ranges mixed with their length; hashes of
runs of words are ranges of a second polynomial over the word hashes. Two independent bases give 128 bits.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _rng.integers(0, 2**64, 256, dtype=_U)
#: Odd bases, each with its inverse modulo 2**64.
_BASES = [int(x) | 1 for x in _rng.integers(0, 2**64, 4, dtype=_U)]
_INVERSE = [pow(b, -1, 2**64) for b in _BASES]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as needed."""
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        size = max(n, 1 << 16)
        p = np.ones(1, dtype=_U)
        step = base
        while len(p) < size:
            p = np.concatenate([p, p * _U(step)])
            step = step * step % 2**64
        if size <= 1 << 22:
            _POWERS[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def prefix_sums(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums (one longer than the input) of values[i] * base**i."""
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * _powers(_BASES[which], len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal content wherever it stands."""
    return (sums[end] - sums[start]) * _powers(_INVERSE[which], len(sums))[start]


def rolling(sums: np.ndarray, width: int, which: int) -> np.ndarray:
    """range_hash of every run of `width` values."""
    n = max(0, len(sums) - width)
    return (sums[width:] - sums[:n]) * _powers(_INVERSE[which], len(sums))[:n]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, other bytes (so all of UTF-8) unchanged."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`; no word crosses the offsets in `breaks`."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[breaks] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = prefix_sums(byte_values(data), 0)
    return mix(range_hash(sums, start, end, 0) + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def batches(column, limit: int = 2_000_000):
    """Cut an Arrow column of (large) binary into runs of rows with up to about `limit` bytes: (first, offsets, bytes).

    A single longer row is a run of its own, whole.
    """
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(column))
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~values, width)
