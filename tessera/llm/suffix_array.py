"""A suffix array by the difference-cover algorithm, in numpy.

Positions 1 and 2 modulo 3 are the sample. Their triples are sorted and named; if names repeat, the
string of names is sorted by recursion. Positions 0 modulo 3 are then sorted by their first symbol and the
rank of the next position, and merged with the sample by rank.
"""

from __future__ import annotations

import numpy as np


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each key's name: its rank among the distinct keys, from 1."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))
    return order, name


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (integers over zero) in order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    base = int(t.max()) + 1
    extra = n % 3 == 1  # a sampled position at the end of the string, so that every position 0 has a sampled neighbour
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if base < 1 << 20:
        key = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    else:
        _, pair = _dense(t[sample + 1] * base + t[sample + 2])
        key = t[sample] * (len(sample) + 2) + pair
    order, name = _dense(key)
    if int(name.max()) < len(sample):
        order = suffix_array(name)
    rank = np.zeros(n + 4, np.int64)
    sorted_sample = sample[order]
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    m = len(sample) + 2
    zero = np.arange(0, n, 3)
    key0 = t[zero] * m + rank[zero + 1]
    order0 = np.argsort(key0, kind="stable")
    zero, key0 = zero[order0], key0[order0]
    is_one = sorted_sample % 3 == 1
    first, second = sorted_sample[is_one], sorted_sample[~is_one]
    # Pairs of symbols before a rank, named so that the key stays within 64 bits.
    before = np.concatenate([t[zero] * base + t[zero + 1], t[second] * base + t[second + 1]])
    _, named = _dense(before)
    less = np.searchsorted(t[first] * m + rank[first + 1], key0)
    less += np.searchsorted(named[len(zero) :] * m + rank[second + 2], named[: len(zero)] * m + rank[zero + 2])
    out = np.empty(n, np.int64)
    at = less + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sorted_sample
    return out
