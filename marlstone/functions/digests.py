"""MD5 of many short texts at once, on whole arrays of 32-bit words.

A text is a common beginning and some decimal digits of its own, and fills one
block; words that all texts share stay plain numbers.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = tuple(int(abs(math.sin(i + 1)) * 2**32) for i in range(64))
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
#: Bytes of a text that leave room for its end and length in one block.
ROOM = 55


def decimals(numbers: np.ndarray) -> np.ndarray:
    """One row a character of numbers that have equally many digits."""
    width = len(str(int(numbers[0])))
    return np.stack([(numbers // 10**k % 10 + ord("0")).astype(np.uint32) for k in range(width - 1, -1, -1)])


def md5_words(start: bytes, digits: np.ndarray) -> list[np.ndarray]:
    """The digests of ``start`` followed by each column of ``digits``: the four
    numbers that eight hexadecimal digits each make."""
    size = len(start) + len(digits)
    if size > ROOM:
        raise ValueError("a text does not fit one block")
    text = [*start, *digits, 0x80, *[0] * (ROOM - size), *(8 * size).to_bytes(8, "little")]
    words = []
    for w in range(16):
        plain = sum(x << 8 * k for k, x in enumerate(text[4 * w : 4 * w + 4]) if isinstance(x, int))
        own = [x << np.uint32(8 * k) for k, x in enumerate(text[4 * w : 4 * w + 4]) if not isinstance(x, int)]
        words.append((plain, sum(own[1:], own[0]) if own else None))
    a, b, c, d = (np.full(digits.shape[1], x, np.uint32) for x in _START)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            f, at = ((c ^ d) & b) ^ d, i
        elif kind == 1:
            f, at = ((b ^ c) & d) ^ c, (5 * i + 1) % 16
        elif kind == 2:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = (b | ~d) ^ c, 7 * i % 16
        plain, own = words[at]
        f += a
        f += np.uint32((plain + _SINES[i]) % 2**32)
        if own is not None:
            f += own
        turn = _TURNS[kind][i % 4]
        low = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    return [(x + np.uint32(s)).byteswap() for x, s in zip((a, b, c, d), _START)]
