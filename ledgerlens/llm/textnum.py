"""Vectorised text arithmetic for use inside tasks: code points, word and k-gram hashes.

Several texts are joined into one buffer of at most `LIMIT` code points (or one longer
text), so numpy's call overhead is paid per buffer and memory stays bounded by the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

LIMIT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly (wrapping arithmetic)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=2)
def _plane(kind: str) -> np.ndarray:
    return np.array([getattr(chr(i), kind)() for i in range(0x10000)])


def chars_are(kind: str, codes: np.ndarray) -> np.ndarray:
    """What the string method `kind` (isalnum, isalpha) says of each code point."""
    out = _plane(kind)[np.minimum(codes, 0xFFFF)]
    if codes.size and int(codes.max()) > 0xFFFF:
        at = np.flatnonzero(codes > 0xFFFF)
        values, back = np.unique(codes[at], return_inverse=True)
        out[at] = np.array([getattr(chr(v), kind)() for v in values.tolist()])[back]
    return out


@lru_cache(maxsize=1)
def _powers_upto(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_upto(max(20, int(n + 1).bit_length()))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def buffers(texts: Sequence[str], most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of texts to join, of at most `most` texts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > LIMIT or i - start >= most):
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (code + 1) * base^position over i <= position < j."""
    up, _ = powers(codes.size)
    out = np.empty(codes.size + 1, np.uint64)
    out[0] = 0
    np.cumsum((codes.astype(np.uint64) + _U(1)) * up[: codes.size], out=out[1:])
    return out


def word_hashes(texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each buffer: the index of its first text, the hashes of its words in order, and
    for each of its texts where its words begin in that array (one more entry at the end)."""
    for lo, hi in buffers(texts):
        joined = "\x00".join(texts[lo:hi])
        codes = codes_of(joined)
        flags = np.zeros(codes.size + 2, np.int8)
        flags[1:-1] = chars_are("isalnum", codes)
        edge = np.diff(flags)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        s = prefix_hash(codes)
        _, down = powers(codes.size)
        words = mix((s[end] - s[begin]) * down[begin])
        first = np.cumsum([0, *(len(t) + 1 for t in texts[lo:hi])])
        yield lo, words, np.searchsorted(begin, first)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter, non-empty text has one, of all its words."""
    n = words.size
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j]
    return mix(out + _U(k))
