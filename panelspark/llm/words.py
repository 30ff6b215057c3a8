"""Words and word shingles of texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: ASCII marks that are no part of a word.
MARKS = "".join(chr(c) for c in range(33, 127) if not WORD.match(chr(c)))
SHINGLE = 5
#: Tokens a worker remembers; beyond that it starts anew.
CACHE = 400_000

_U = np.uint64
#: Odd multipliers, one for each place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of its input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hashes, as bytes, of the lower-case words in a token without white space."""

    def __missing__(self, token: str) -> bytes:
        word = token.lower().strip(MARKS)
        if word.isalnum():
            hashes = xxhash.xxh64_digest(word)
        else:
            hashes = b"".join(xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass")) for w in WORD.findall(word))
        if len(token) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[token] = hashes
        return hashes


_hashes = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word of the whole text; a word is a run of letters, digits and underscores."""
    return np.frombuffer(b"".join(map(_hashes.__getitem__, (text or "").split())), np.uint64)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; fewer words are one shingle, none are none."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    total = words[:n] * PLACES[0]
    for k in range(1, size):
        total = total + words[k : n + k] * PLACES[k]
    return mixed(total)
