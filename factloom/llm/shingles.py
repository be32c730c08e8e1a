"""Hashed word shingles of whole texts, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9FB21C651E98DF25)
_K = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and its inverse modulo 2 ** 64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_P, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray, key: int = 0) -> np.ndarray:
    """Another order of the same numbers for each key (a bijection of 64 bits)."""
    h = (h ^ np.uint64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _K
    h = (h ^ (h >> np.uint64(32))) * _K
    return h ^ (h >> np.uint64(29))


def sets(texts: list, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: A-Z folded, words as [^\\x20\\x09-\\x0D]+.

    A text of fewer words has one shingle, all its words; one without words, or None, has none.
    """
    raw = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    n = np.array([len(b) for b in raw], dtype=np.int64)
    end = np.cumsum(n + 1)
    a = _FOLD[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
    up, down = _power(len(a) + 1)
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])))
    w = mix((s[last] - s[first]) * down[first])
    count = np.diff(np.concatenate(([0], np.searchsorted(first, end))))
    h = w
    if len(w) >= width:
        h = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            h = mix(h * _P + w[k : len(w) - width + 1 + k])
    at = 0
    for c in count:
        if c >= width:
            yield np.unique(h[at : at + c - width + 1])
        elif c:
            g = w[at : at + 1]
            for k in range(1, c):
                g = mix(g * _P + w[at + k : at + k + 1])
            yield mix(g, int(c))
        else:
            yield w[:0]
        at += c


def class_of(s: np.ndarray) -> int:
    """One signed 64-bit number for a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s, 3).sum() ^ (mix(s, 5).sum() << np.uint64(1)) ^ np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])
