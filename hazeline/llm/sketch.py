"""A count-min sketch of 64-bit digests whose counters stop at two: enough to prove that a digest occurs once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.arrays import mix
from hazeline.llm.tables import written

ROWS = 3
#: Cells in a row at most: 12 MiB of bits for all rows. Beyond it more digests seem shared, which costs time and never a result.
MOST_CELLS = 1 << 25
_BLOCK = 1 << 15
_SHIFTS = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(ROWS)]


def width(n: int) -> int:
    """Cells in a row for n digests: four for each, a power of two."""
    return min(MOST_CELLS, max(_BLOCK, 1 << (4 * max(n, 1) - 1).bit_length()))


def cells(digests: np.ndarray, wide: int) -> np.ndarray:
    """The cells (rows x digests) of digests in a table of ROWS * wide cells."""
    x = digests.view(np.uint64)
    return np.stack([(mix(x + _SHIFTS[r]) & np.uint64(wide - 1)).astype(np.int64) + r * wide for r in range(ROWS)])


def repeated_cells(df: DataFrame, digest: str, wide: int) -> bytes:
    """One bit for each cell: whether two or more rows meet in it. Its size is bounded by MOST_CELLS."""
    blocks = ROWS * wide // _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ROWS * wide, np.uint8)
        for batch in batches:
            at, n = np.unique(cells(batch.column(0).to_numpy(), wide), return_counts=True)
            table[at] = np.minimum(table[at] + np.minimum(n, 2), 2)
        by = table.reshape(blocks, _BLOCK)
        for k in np.flatnonzero(by.any(axis=1)).tolist():
            bits = [np.packbits(by[k] > least).tobytes() for least in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits[0]], pa.binary()), pa.array([bits[1]], pa.binary())], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["block", "twice"])

        for batch in batches:
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if k != block:
                    if block is not None:
                        yield done()
                    block, once, twice = k, a, b
                else:
                    once, twice = once | a, twice | b | (once & a)
        if block is not None:
            yield done()

    parts = df.select(digest).mapInArrow(count, "block int, once binary, twice binary")
    merged = written(parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice binary"), "sketch")
    table = bytearray(ROWS * wide // 8)
    for row in merged.filter(F.col("twice").isNotNull()).toLocalIterator():
        table[row.block * _BLOCK // 8 : (row.block + 1) * _BLOCK // 8] = row.twice
    return bytes(table)


def seem_repeated(digests: np.ndarray, table: np.ndarray, wide: int) -> np.ndarray:
    """Whether the sketch (its bits as bytes) leaves open that a digest occurs twice; where it doesn't, it occurs once."""
    at = cells(digests, wide)
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
