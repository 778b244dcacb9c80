"""Variable-capacity best-fit packing of documents into training sequences.

Packing sees lengths only, and there are at most as many lengths as the largest capacity. Spark counts documents per length; the plan works
on that histogram (bounded by the capacity, whatever the corpus): lengths descend, each goes to the open bins with the least room
that holds it, and a new bin takes the permitted capacity of least cost for each token it can be filled with from what is still to come. At the
end every bin shrinks to the least permitted capacity that holds its contents. Bins of one pattern are kept as one row with a count, so the
plan is exact best-fit decreasing over the whole corpus. Spark then ranks the pieces of each length and joins ranks to the plan.

A document longer than the largest capacity becomes pieces of that capacity and a rest. Nulls and texts without words have no piece: one row with
piece, bin and offset null. Repeated rows are packed separately. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.tables import n_words, written

CAPACITIES = (512, 1024, 2048, 4096, 8192)
_BUCKETS = 64


def sequence_cost(capacity: int) -> float:
    """Cost of one padded sequence: its tokens, attention over them, and a fixed part."""
    return capacity * (1 + capacity / 65536) + 16


def _fill(room: int, lengths: list[int], left: dict[int, int]) -> int:
    """Tokens that the largest fitting lengths still to come put into the room."""
    start, at = room, bisect_right(lengths, room)
    while at and room:
        length = lengths[at - 1]
        room -= length * min(left[length], room // length)
        at = bisect_right(lengths, min(room, length - 1))
    return start - room


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> list[tuple[int, int, int, int, int, int, int]]:
    """Slots (length, first rank, ranks, items a bin, first bin, offset, capacity) for lengths with counts; every rank of a length is in one slot."""
    capacities = sorted(capacities)
    lengths = sorted(histogram)
    left = dict(histogram)
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(room: int, pattern: tuple[tuple[int, int], ...], bins: int) -> None:
        if bins:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((pattern, bins))

    for length in reversed(list(lengths)):
        count = left[length]
        lengths.pop()
        at = bisect_left(rooms, length)
        while count and at < len(rooms):
            room = rooms[at]
            each, same = room // length, open_[room]
            while count and same:
                pattern, bins = same.pop()
                whole = min(bins, count // each)
                put(room - each * length, (*pattern, (length, each)), whole)
                count -= whole * each
                if whole < bins and count:
                    put(room - count * length, (*pattern, (length, count)), 1)
                    whole, count = whole + 1, 0
                if whole < bins:
                    same.append((pattern, bins - whole))
            if not same:
                del open_[room]
                rooms.remove(room)
            at = bisect_right(rooms, room)
        while count:
            fits = [c for c in capacities if c >= length]

            def price(capacity: int) -> float:
                own = length * min(count, capacity // length)
                return cost(capacity) / (own + _fill(capacity - own, lengths, left))

            capacity = min(fits, key=price)
            each = min(count, capacity // length)
            put(capacity - each * length, ((length, each),), count // each)
            count %= each
    slots, given, first_bin = [], dict.fromkeys(histogram, 0), 0
    for room in rooms:
        for pattern, bins in open_[room]:
            content = sum(length * each for length, each in pattern)
            capacity = capacities[bisect_left(capacities, content)]
            at = 0
            for length, each in pattern:
                slots.append((length, given[length], bins * each, each, first_bin, at, capacity))
                given[length] += bins * each
                at += length * each
            first_bin += bins
    return slots


_SLOT = ["slot_length", "slot_first", "slot_ranks", "slot_each", "slot_bin", "slot_offset", "bin_capacity"]


def packed(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, tokens: Column | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_capacity, bin_offset) of each piece of docs (doc_id, text). tokens: length of a text, its words if not given."""
    most = max(capacities)
    size = n_words(F.col("text")) if tokens is None else tokens
    sizes = docs.select("doc_id", size.cast("bigint").alias("size"), F.xxhash64("doc_id", "text").alias("hash"))
    count = F.when(F.col("size") > 0, F.expr(f"(size - 1) div {most}"))
    pieces = sizes.select("doc_id", "hash", "size", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), count)).alias("piece"))
    length = F.when(F.col("piece").isNull(), 0).otherwise(F.least(F.lit(most).cast("bigint"), F.col("size") - F.col("piece") * most))
    # Buckets by hash and place spread equal rows.
    bucket = F.pmod(F.xxhash64("hash", "piece", F.monotonically_increasing_id()), F.lit(_BUCKETS))
    pieces = written(pieces.select("doc_id", "hash", "piece", length.cast("bigint").alias("n_tokens"), bucket.alias("bucket")), "pieces")
    full = pieces.filter("n_tokens > 0")
    cells = written(full.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")), "lengths")
    # At most one row for each length up to the largest capacity.
    histogram = {int(r[0]): int(r[1]) for r in cells.groupBy("n_tokens").agg(F.sum("n")).collect()}
    slots = plan(histogram, capacities, cost)
    columns = [pa.array([s[k] for s in slots], pa.int64()) for k in range(len(_SLOT))]
    slots = docs.sparkSession.createDataFrame(pa.table(columns, names=_SLOT))
    along = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("hash", "doc_id", "piece"))
    placed = full.withColumn("own", own).join(cells, ["n_tokens", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    within = F.col("rank") - F.col("slot_first")
    placed = placed.join(slots, (F.col("n_tokens") == F.col("slot_length")) & (F.col("rank") >= F.col("slot_first")) & (F.col("rank") < F.col("slot_first") + F.col("slot_ranks")))
    placed = placed.select(
        "doc_id", "piece", "n_tokens", (F.col("slot_bin") + F.expr("(rank - slot_first) div slot_each")).alias("bin_id"), "bin_capacity",
        (F.col("slot_offset") + within % F.col("slot_each") * F.col("n_tokens")).alias("bin_offset"),
    )
    none = pieces.filter("n_tokens = 0").select("doc_id", "piece", "n_tokens", *(F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "bin_capacity", "bin_offset")))
    return placed.unionByName(none)
