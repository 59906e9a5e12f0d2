"""Vectorised text helpers that run inside tasks: words, shingles and their 64-bit hashes.

A word is a maximal run of letters and digits of the lower-cased text. A shingle is five
consecutive words; a text of one to four words has one shingle, made of all of them, and a
text without words has none.
"""

from __future__ import annotations

import re

import numpy as np

SHINGLE_WORDS = 5
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_NOT_WORD = re.compile(r"[^\w\x00-\x7f]")
_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; grown by doubling and kept."""
    have = _powers.get(name)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the result depend on all bits of the input."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order: polynomial hashes from one running sum."""
    if not text:
        return np.zeros(0, np.uint64)
    s = text.lower()
    if not s.isascii():
        s = _NOT_WORD.sub(" ", s)
    b = np.frombuffer(s.encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _CLASS[b]
    turn = np.flatnonzero(np.diff(inside))
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    return slice_hashes(b, start, end)


def slice_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of a buffer of bytes; it depends on the slice's bytes alone."""
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * _power("up", _P, len(b)), out=run[1:])
    h = (run[end] - run[start]) * _power("down", _P_INV, len(b) + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash of each run of n words; of all the words where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(_P) + words[i : i + m]
    return mix(h)
