"""Word-shingle hashes of whole texts, vectorised over Arrow buffers.

Words are runs of bytes other than the six ASCII white-space characters, with A-Z lower-cased. A
word's hash is a polynomial over its bytes modulo 2**64, read off running sums; a shingle's hash
mixes its words' hashes. Texts with fewer words than a shingle are one shingle, texts without words
have none.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each row); is_gap: the bytes between words."""
    n = len(offsets) - 1
    text = np.full(len(data) + n + 1, 32, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = _LOWER[data]
    starts = offsets[:-1] + np.arange(n)
    gap = is_gap[text]
    begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    power, inverse = powers(len(text))
    sums = np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)
    words = mix((sums[end - 1] - sums[begin - 1]) * inverse[begin] + (end - begin).astype(np.uint64))
    at = np.searchsorted(begin, np.append(starts, len(text)))
    return words, np.diff(at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row after row, sorted within each; their number in each row)."""
    words, per_row = word_hashes(data, offsets)
    rows = np.repeat(np.arange(len(per_row)), per_row)
    first = np.cumsum(per_row) - per_row
    total = max(0, len(words) - k + 1)
    value = np.full(total, np.uint64(k), np.uint64)
    for j in range(k):
        value = mix(value * np.uint64(0xD1342543DE82EF95) + words[j : j + total])
    whole = rows[:total] == rows[k - 1 : k - 1 + total] if total else np.zeros(0, bool)
    hashes, owner = [value[whole]], [rows[:total][whole]]
    for r in np.flatnonzero((per_row > 0) & (per_row < k)):
        v = np.array([per_row[r]], np.uint64)
        for h in words[first[r] : first[r] + per_row[r]]:
            v = mix(v * np.uint64(0xD1342543DE82EF95) + h)
        hashes.append(v)
        owner.append(np.array([r]))
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
        h, o = h[new], o[new]
    return h, np.bincount(o, minlength=len(per_row)).astype(np.int64)
