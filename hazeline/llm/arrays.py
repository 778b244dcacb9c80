"""Words and lines of whole text columns as NumPy arrays over their UTF-8 bytes.

White space of the contracts is ASCII, so words can be cut in the bytes. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer text is cut between words.
BLOCK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20)
_COEF = _RANDOM.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = _RANDOM.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2)
_FAR[0] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one more entry than rows)."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[part]
    cut = np.zeros(len(part) + 1, bool)  # a row begins here
    cut[offsets - base] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(first) + base
    return starts, np.flatnonzero(last) + 1 + base, np.searchsorted(starts, offsets)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    part = data[lo:hi]
    lengths = np.diff(np.append(starts, hi))
    at = np.arange(hi - lo, dtype=np.int64) - np.repeat(starts - lo, lengths)
    values = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
    values[SPACE[part]] = 0
    coef = _COEF[at & 4095]
    if int((ends - starts).max()) > 4096:
        coef = coef + _FAR[(at >> 12) & 4095]
    values *= coef
    return mix(np.add.reduceat(values, starts - lo) ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each row's first word; A-Z count as a-z if lower."""
    if int(offsets[-1] - offsets[0]) <= 2 * BLOCK:
        starts, ends, words = word_bounds(data, offsets)
        return _hashes(data, starts, ends, lower), words
    found, firsts, total = [], [0], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while a < b:
            end = b
            if b - a > BLOCK:
                spaces = np.flatnonzero(SPACE[data[a + BLOCK // 2 : a + BLOCK]])
                if len(spaces):
                    end = a + BLOCK // 2 + int(spaces[-1])
                else:  # one very long word: up to the next white space
                    rest = SPACE[data[a + BLOCK : b]]
                    end = a + BLOCK + int(rest.argmax()) if rest.any() else b
            starts, ends, _ = word_bounds(data, np.array([a, end]))
            found.append(_hashes(data, starts, ends, lower))
            total += len(found[-1])
            a = end
        firsts.append(total)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.array(firsts)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words of one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
        out ^= out >> np.uint64(32)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
