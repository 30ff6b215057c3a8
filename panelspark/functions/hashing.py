"""Deterministic pseudo-random numbers.

Every random operator draws from a hash of (seed, key): a lost task that runs
again makes the same choice, and the same number can be had in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5
from math import sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 1 << 32


def h32(seed: int | str, *keys: Column) -> Column:
    """Uniform integer in [0, 2**32) from the seed and the key columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit(seed: int | str, *keys: Column) -> Column:
    """Uniform number in [0, 1)."""
    return h32(seed, *keys) / F.lit(float(HASH_SPAN))


# MD5's constants, a step's bits of rotation, and the hashes taken at a time: their columns stay in a core's cache.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
AT_ONCE = 32768


def h32_of_pairs(lefts: Sequence[str], rights: Sequence[str]) -> np.ndarray:
    """``h32`` of each left text followed by each right one, as (rights, lefts): for tasks that need millions of them."""
    out = np.empty((len(rights), len(lefts)), np.uint32)
    for a, some in _of_one_length(lefts):
        for b, others in _of_one_length(rights):
            n = len(some[0]) + len(others[0])
            if n > 55:
                # more than one block of MD5
                out[np.ix_(b, a)] = [[int(md5(x + y).hexdigest()[:8], 16) for x in some] for y in others]
                continue
            size = n // 4 + 1
            head = _words([x.ljust(4 * size, b"\0") for x in some], size)
            tail = _words([y.rjust(n, b"\0").ljust(n + 1, b"\x80").ljust(4 * size, b"\0") for y in others], size)
            step = max(1, AT_ONCE // len(some))
            for at in range(0, len(others), step):
                # left and right share one word at most; before it the right is 0, behind it the left
                words = [head[k][None] | tail[k][at : at + step, None] if (4 * k < len(some[0]) < 4 * k + 4) else (head[k][None] if 4 * k < len(some[0]) else tail[k][at : at + step, None]) for k in range(size)]
                out[np.ix_(b[at : at + step], a)] = _first_word(words, n, (len(others[at : at + step]), len(some)))
    return out


def _of_one_length(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(places, texts) for each length of the encoded texts."""
    coded = [t.encode() for t in texts]
    sizes = np.array([len(t) for t in coded])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, [coded[i] for i in at.tolist()]


def _words(texts: list[bytes], size: int) -> np.ndarray:
    """Word k of all texts as row k."""
    return np.ascontiguousarray(np.frombuffer(b"".join(texts), "<u4").reshape(-1, size).T)


def _first_word(words: list[np.ndarray], n: int, shape: tuple[int, int]) -> np.ndarray:
    """The first four bytes of the MD5 of texts of ``n`` bytes, given as columns of words; the last three steps do not reach them."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        f += a
        f += words[g] + np.uint32(_SINES[i]) if g < len(words) else np.uint32((_SINES[i] + (8 * n if g == 14 else 0)) % HASH_SPAN)
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap()
