"""Vectorised word and shingle hashes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed by itself.
SLICE_BYTES = 2_000_000

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most)) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first word's index (with
    the number of words at the end)."""
    inside = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets < len(data)) & (offsets > 0)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.cumsum(inside) - 1  # index among word bytes
    first = at[starts]
    body = data[inside]
    lens = np.diff(first, append=len(body))
    place = np.arange(len(body)) - np.repeat(first, lens)
    powers = _powers(int(lens.max()))
    h = np.add.reduceat(_BYTE[_LOWER[body] if lower else body] * powers[place], first)
    return mix(h + lens.astype(np.uint64) * _BASE), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  A text of fewer words than
    ``width`` has its whole word sequence as one; one without words has none."""
    h, first = word_hashes(data, offsets)
    joined = h.copy()
    for k in range(1, width):
        joined = mix(joined[: len(h) - k] * _BASE + h[k:])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            s = h[a : a + 1]
            for k in range(a + 1, b):
                s = mix(s * _BASE + h[k : k + 1])
            out.append(mix(s ^ _U(b - a)))
        else:
            out.append(h[:0])
    return out


def functions(n: int, seed: int) -> list[tuple[np.uint64, np.uint64]]:
    """Multipliers (odd) and addends of ``n`` hash functions."""
    rng = np.random.default_rng(seed)
    return [(_U(int(a) | 1), _U(int(b))) for a, b in rng.integers(0, 2**63, (n, 2), dtype=np.uint64)]
