"""Suffix arrays by induced sorting, and common prefixes of neighbours in text order.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller ones are sorted by their substrings, where these repeat by
the order of the substrings' numbers, and all others are induced from them. A bucket's suffixes are induced as arrays, in waves of equal bytes; suffixes of
numbers are ordered by ranks over twice as many numbers each round. The end of the text counts as smaller than any letter.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one."""
    differs = np.flatnonzero(t[:-1] != t[1:])
    out = np.zeros(len(t), bool)  # an equal run up to the end is larger than the end
    if len(differs):
        out[: differs[-1] + 1] = np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1))
    return out


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induced_bytes(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, whole: bool) -> np.ndarray:
    """All suffixes (or the leftmost-smaller ones) in the order induced by that of lms."""
    n = len(t)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    lower: list[list[np.ndarray]] = [[] for _ in range(256)]
    done: list[np.ndarray] = [lms[:0]] * 256
    letters = np.flatnonzero(np.bincount(t, minlength=256)).tolist()

    def deal(found: np.ndarray, to: list[list[np.ndarray]]) -> None:
        if len(found):
            c = t[found]
            order = np.argsort(c, kind="stable")
            found, c = found[order], c[order]
            cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for k, letter in enumerate(c[cuts[:-1]].tolist()):
                to[letter].append(found[cuts[k] : cuts[k + 1]])

    c = t[lms]
    order = np.argsort(c, kind="stable")
    cuts = np.searchsorted(c[order], np.arange(257))
    of_bucket = [lms[order[cuts[k] : cuts[k + 1]]] for k in range(256)]
    larger[t[n - 1]].append(np.array([n - 1]))
    for c in letters:
        waves, now = [], np.concatenate(larger[c]) if larger[c] else lms[:0]
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            same = t[before] == c
            deal(before[~same], larger)
            now = before[same]
        done[c] = np.concatenate(waves) if waves else lms[:0]
        deal(of_bucket[c] - 1, larger)
    ends: list[np.ndarray] = [lms[:0]] * 256
    for c in reversed(letters):
        waves, now = [], np.concatenate(lower[c]) if lower[c] else lms[:0]
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            same = t[before] == c
            deal(before[~same], lower)
            now = before[same]
        ends[c] = np.concatenate(waves)[::-1] if waves else lms[:0]
        last = done[c][::-1]
        before = last[last > 0] - 1
        deal(before[smaller[before]], lower)
    if whole:
        return np.concatenate([x for c in letters for x in (done[c], ends[c])])
    found = np.concatenate([ends[c] for c in letters])
    return found[(found > 0) & ~smaller[found - 1]]


def _ordered_numbers(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of numbers in order: by as many numbers as a key holds, then those that still agree by twice as many each round."""
    n, bits = len(s), (int(s.max()) + 1).bit_length()
    step = max(1, 63 // bits)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << bits | padded[k : k + n]
    sa, places = np.argsort(key, kind="stable"), np.arange(n)
    rank, key = np.empty(n + step, np.int64), key[sa]
    items = sa
    while True:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        rank[items] = np.repeat(places[first], size)  # of suffixes that agree so far, their first place
        agree = np.repeat(size > 1, size)
        if not agree.any():
            return sa
        places, items = places[agree], items[agree]
        after = items + step
        key = rank[items] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, items = key[order], items[order]
        sa[places] = items
        step *= 2


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each leftmost-smaller substring in text order, equal ones alike, and how many numbers there are."""
    ends = np.append(lms[1:], len(t) - 1)  # the last one ends with the text, which makes it unlike all others
    at = np.searchsorted(lms, ordered)
    lengths = ends[at] - ordered + 1
    same = lengths[1:] == lengths[:-1]
    same &= (at[1:] != len(lms) - 1) & (at[:-1] != len(lms) - 1)
    pairs = np.flatnonzero(same)
    if len(pairs):
        size = lengths[pairs]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = t[np.repeat(ordered[pairs], size) + step] == t[np.repeat(ordered[pairs + 1], size) + step]
        same[pairs] = np.logical_and.reduceat(equal, first)
    numbers = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(lms), np.int64)
    out[at] = numbers
    return out, int(numbers[-1]) + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; t holds bytes (uint8) or numbers from 0."""
    if len(t) < 2:
        return np.arange(len(t))
    if t.dtype != np.uint8:
        return _ordered_numbers(t)
    smaller = _smaller(t)
    lms = _leftmost(smaller)
    ordered = lms
    if len(lms):
        ordered = _induced_bytes(t, smaller, lms, False)
        names, different = _names(t, lms, ordered)
        if different < len(lms):
            ordered = lms[_ordered_numbers(names)]
    return _induced_bytes(t, smaller, ordered, True)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in text order, how many bytes (most at most) it shares with the suffix before it in sa; bytes after the end are zero."""
    size = -(-(len(t) + most) // 8) * 8
    padded = np.concatenate([t, np.zeros(size + 8 - len(t), np.uint8)])
    words = np.empty((size // 8, 8), np.uint64)
    for k in range(8):  # the first byte is the lowest
        words[:, k] = padded[k : k + size].view("<u8")
    words = words.ravel()
    before = np.full(len(t), -1)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)
    out = np.full(len(t), most)
    out[sa[:1]] = 0
    to = before[at]
    for step in range(0, most, 8):
        x = words[at + step] ^ words[to + step]
        equal = x == 0
        x = x[~equal]
        lowest = np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64)
        out[at[~equal]] = step + lowest // 8
        at, to = at[equal], to[equal]
    return np.minimum(out, most)
