"""Words of UTF-8 bytes by NumPy, for operators that run inside tasks."""

from __future__ import annotations

import numpy as np


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set outside the given ranges."""
    flags = np.ones(256, np.int8)
    for low, high in ranges:
        flags[low : high + 1] = 0
    return flags


#: Words without ASCII white space.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of lower-case letters, digits and everything beyond ASCII.
PLAIN = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def word_bounds(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes in a class."""
    edges = np.diff(inside[np.frombuffer(data, np.uint8)], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


_U = np.uint64
#: An odd base, so that its powers have inverses modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _grown_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    if len(_powers[0]) < size:
        size = max(size, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, _U)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=_U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length.

    Prefix sums give all words of a stretch at once; stretches keep memory
    bounded for long texts.
    """
    codes = np.frombuffer(data, np.uint8)
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, origin + _CHUNK, "right")))
        size = int(ends[upto - 1]) - origin
        powers, inverses = _grown_powers(size + 1)
        sums = np.zeros(size + 1, _U)
        np.cumsum((codes[origin : origin + size].astype(_U) + _U(1)) * powers[:size], out=sums[1:])
        s, e = starts[at:upto] - origin, ends[at:upto] - origin
        out[at:upto] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        at = upto
    return out


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without ASCII white space, A-Z lower-cased.  A text with
    fewer words is one shingle of them all; a text without words has none.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    starts, ends = word_bounds(data, SPACED)
    words = word_hashes(data, starts, ends)
    if not len(words):
        return words
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, (size * 0xA24BAED4963EE407) & 0xFFFFFFFFFFFFFFFF, _U)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * _U(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
    return np.unique(mix(total))
