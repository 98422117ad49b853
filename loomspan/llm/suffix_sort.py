"""Difference-cover suffix sorting of byte strings, to a bounded depth, in numpy.

Positions that aren't multiples of three are the sample: their triples are sorted and
named, the names sorted by recursion, and the remaining suffixes, sorted by one symbol
and the rank of a sampled suffix, are merged in. A recursion level triples the bytes
that a name stands for, so the recursion ends once names are distinct or cover ``depth``
bytes; suffixes that agree on so many then rank as equal.
"""

from __future__ import annotations

import numpy as np


def _names(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of the tuples that the keys make up."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks from 1 of the suffixes of ``s`` (symbols from 1), at least to ``depth`` symbols."""
    n = len(s)
    if n < 4:
        padded = np.concatenate([s, np.zeros(4, np.int64)])
        return _names(*[padded[k : k + n] for k in range(4)])
    x = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    top = int(x.max()) + 1
    one, two, rest = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    if top < 1 << 20:
        names = _names((x[sample] * top + x[sample + 1]) * top + x[sample + 2])
    else:
        names = _names(x[sample], x[sample + 1], x[sample + 2])
    if depth > 3 and names.max() < len(sample):
        # a zero between the two residues keeps their suffixes apart
        joined = np.concatenate([names[: len(one)] + 1, [1], names[len(one) :] + 1])
        ranks = suffix_ranks(joined, -(-depth // 3))
        names = _names(np.concatenate([ranks[: len(one)], ranks[len(one) + 1 :]]))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    wide = int(names.max()) + 2
    # what compares a multiple of three with a position of either residue
    by_one = lambda i: x[i] * wide + rank[i + 1]
    if top * top < (1 << 62) // wide:
        pair = lambda i: x[i] * top + x[i + 1]
    else:
        names2 = _names(x[:-1], np.append(x[1:-1], 0))
        pair = lambda i: names2[i]
    by_two = lambda i: pair(i) * wide + rank[i + 2]
    rest_one, rest_two = by_one(rest), by_two(rest)
    sorted_one, sorted_two = np.sort(by_one(one)), np.sort(by_two(two))
    own_one, own_two = np.sort(rest_one), np.sort(rest_two)
    before = np.empty(n, np.int64)
    before[rest] = np.searchsorted(own_one, rest_one) + np.searchsorted(sorted_one, rest_one) + np.searchsorted(sorted_two, rest_two)
    sorted_names = np.sort(names)
    before[one] = np.searchsorted(sorted_names, rank[one]) + np.searchsorted(own_one, by_one(one))
    before[two] = np.searchsorted(sorted_names, rank[two]) + np.searchsorted(own_two, by_two(two))
    return before + 1


def equal_prefix_groups(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A group number for each start: equal where the next ``length`` bytes are equal.

    The starts are put in suffix order and each is compared with its neighbour there.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(text.astype(np.int64) + 1, length)
    order = starts_order = np.argsort(ranks[starts], kind="stable")
    p = starts[starts_order]
    word = np.zeros(len(text) + 8, np.uint64)
    padded = np.concatenate([text, np.zeros(16, text.dtype)]).astype(np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)] << np.uint64(8 * k)
    same = np.arange(1, len(p))
    for k in sorted({*range(0, max(1, length - 7), 8), max(0, length - 8)}):
        same = same[word[p[same] + k] == word[p[same - 1] + k]]
    new = np.ones(len(p), bool)
    new[same] = False
    out = np.empty(len(p), np.int64)
    out[order] = np.cumsum(new)
    return out
