"""Words and 64-bit word hashes of many texts at once, by arrays over their UTF-8 bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))[_LOWER]

#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text with A-Z in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        n = max(n, 1 << 20)
        seq = np.full(n, base, U)
        seq[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(seq)
        if n > 1 << 22:  # of an exceptionally long text: not kept
            return have
        _powers[str(base)] = have
    return have


class Words(NamedTuple):
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after it
    first: np.ndarray  #: for each text the number of its first word, and the number of all words
    hash: np.ndarray  #: 64-bit hash of the word with A-Z in lower case
    prefix: np.ndarray = np.zeros(0, U)  #: if asked for, hash of the word's first bytes; 0 of a shorter word


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, prefix: int = 0) -> Words:
    """Words of the texts that lie in ``buf`` at ``offsets``; a word never spans two texts."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(offsets), np.int64), np.zeros(0, U))
    inside = kind[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(start, offsets)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum(_VALUE[buf] * _power(_BASE, n)[:n], out=total[1:])
        back = _power(_INVERSE, n)[start]
        h = mix((total[end] - total[start]) * back + (end - start).astype(U))
        p = np.zeros(0, U)
        if prefix:
            p = mix((total[np.minimum(start + prefix, n)] - total[start]) * back + U(1 << 32))
            p[end - start < prefix] = 0
    return Words(start, end, first, h, p)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for i in range(k):
            out = mix(out * U(0x2545F4914F6CDD1D) + h[i : i + n])
    return out
