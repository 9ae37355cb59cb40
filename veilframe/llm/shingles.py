"""Word shingles of whole texts as sets of 64-bit hashes.

A-Z is lower-cased; words are runs of bytes other than the space and 0x09 to 0x0D.  A text's set has the hashes of
its distinct runs of ``width`` words; a text with fewer words has its whole sequence as its one shingle, and a text
without words has the empty set.
"""

from __future__ import annotations

import numpy as np

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n + n // 2, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many words each text has."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    gap = _GAP[data]
    edge = np.diff(gap.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(start):
        end = end[len(end) - len(start) :]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    words = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return words, np.diff(np.searchsorted(start, begins))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        own = words[at : at + n]
        at += n
        if n == 0:
            out.append(own)
            continue
        k = min(width, n)
        total = np.full(n - k + 1, k * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
        for i in range(k):  # the order of words counts
            total = mix(total + own[i : n - k + 1 + i])
        out.append(np.unique(total))
    return out


def set_hash(own: np.ndarray) -> int:
    """A signed 64-bit hash of a set; equal sets have equal hashes."""
    value = mix(mix(own).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    return int(value.view(np.int64)[0])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
