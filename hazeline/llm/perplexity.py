"""Quality rules by n-gram perplexity: a modified Kneser-Ney model of character 4-grams for each language, and perplexity bands.

Spark counts the 4-grams of all texts, and the counts of lower orders, discounts, back-off weights and probabilities are joins and groups over the counted
n-grams. Characters are UTF-16 code units, so that four fill a 64-bit key exactly. They are used because their n-grams repeat: a model of words would be
as large as the corpus. A text belongs to one of two halves by its hash, and is scored by the model of its language that the other half gave:
neither a text nor its exact copies count for themselves.

The model is exact and grows with the input. Its most frequent 4-grams, at most CORE of them, are an array sorted by 64-bit hashes that every scoring task holds. Whatever
4-gram a text has beyond those is counted for the text and joined with the whole model by Spark, backing off order by order; so CORE changes no result.

A language's bands are set by exact quantiles of its documents that pass the base rules. Texts count and are scored whole. A null text is empty; an
empty or short text fails the base rules; null is a language of its own; repeated rows are judged alike. A table without rows gives none. Of
other columns none is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm.arrays import SPACE, mix, slices, utf8, windows, word_hashes
from hazeline.llm.tables import written

ORDER = 4
#: Entries of the frequent part of the model; the rest is joined.
CORE = 1 << 22
MIN_WORDS = 50
#: Limits lie this many times the distance from the median to the lower and upper quartile away from the median (5.4 standard deviations of a
#: normal spread), and at least so many nats, for languages whose texts are all alike.
SPREAD, LEAST_NATS = 8.0, 0.05
#: Bytes of texts that are held as arrays of codes at a time.
SLICE = 1 << 20
_PAD = 2
#: Log probability of a character that the model has never met.
_UNSEEN = -16.0
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIGURES = [("model", "string"), *((x, "bigint") for x in STATS), ("chars", "bigint"), ("known", "double"), ("row", "bigint"), ("rest", "array<bigint>"), ("times", "array<bigint>")]


def lang_key(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("l"), lang), F.lit(""))


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little"))


def half(text: Column) -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2))


def _name(part: Column, lang: Column) -> Column:
    """Name of the model that one half of a language's texts gives."""
    return F.concat(part.cast("string"), lang_key(lang))


def _hashes(keys: np.ndarray, seeds) -> np.ndarray:
    return mix(keys ^ seeds)


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 codes of the rows, each after ORDER - 1 padding codes, and where each row begins (one more entry than rows). White space is one code."""
    part = data[int(offsets[0]) : int(offsets[-1])]
    codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16).astype(np.uint64)
    lead = np.concatenate([[0], np.cumsum(((part & 0xC0) != 0x80).astype(np.int64) + (part >= 0xF0))])
    begins = lead[offsets - offsets[0]]
    codes[(codes == 32) | ((codes >= 9) & (codes <= 13))] = 32
    rows = len(offsets) - 1
    padded = np.full(len(codes) + (ORDER - 1) * rows, _PAD, np.uint64)
    shift = (ORDER - 1) * np.repeat(np.arange(1, rows + 1), np.diff(begins))
    padded[np.arange(len(codes)) + shift] = codes
    return padded, begins + (ORDER - 1) * np.arange(rows + 1)


def _keys(padded: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each code, from the ORDER-th on."""
    n = len(padded) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | padded[k : k + n]
    return out


def _texts(batch: pa.RecordBatch, text: int, lang: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    data, offsets = utf8(batch.column(text))
    langs = batch.column(lang).to_pylist()
    for i, j in slices(offsets, SLICE):
        yield i, data, offsets[i : j + 1], langs[i:j]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets, langs in _texts(batch, 1, 0):
            padded, begins = _codes(data, offsets)
            keys, own = _keys(padded), np.diff(begins) - (ORDER - 1)
            names = sorted(set(langs))
            number = np.searchsorted(np.array(names, object), np.array(langs, object)) if len(names) > 1 else np.zeros(len(langs), np.int64)
            # A row's n-grams begin with its padding; those that end in the next row's padding are skipped.
            real = np.zeros(len(keys) + 1, np.int32)
            np.add.at(real, begins[:-1][own > 0], 1)
            np.add.at(real, (begins[:-1] + own)[own > 0], -1)
            real = np.cumsum(real[:-1]) > 0
            of = np.repeat(number, own)
            keys = keys[real]
            for k, name in enumerate(names):
                found = pc.value_counts(pa.array((keys[of == k] if len(names) > 1 else keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), found.field(0), found.field(1)], ["lang", "key", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, key, n) of every 4-gram of docs (text, lang); lang: half and language; key: its codes, 16 bits each."""
    rows = docs.select(_name(half(F.col("text")), F.col("lang")).alias("lang"), "text")
    return rows.mapInArrow(_count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _estimates(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(lang, key, n, p) of each order from 1, and (lang, key, n, bo) of the contexts of each order from 2."""
    tables = [grams]
    for order in range(ORDER - 1, 0, -1):  # distinct left neighbours
        last = (1 << 16 * order) - 1
        tables.append(tables[-1].groupBy("lang", F.col("key").bitwiseAND(F.lit(last)).alias("key")).agg(F.count("*").alias("n")))
        if order == ORDER - 1:
            tables[-1] = written(tables[-1], "grams3")
    tables.reverse()
    every = tables[0].select(F.lit(1).alias("order"), "lang", "n")
    for order, table in enumerate(tables[1:], 2):
        every = every.unionByName(table.select(F.lit(order).alias("order"), "lang", "n"))
    times = every.groupBy("order", "lang").agg(*(F.sum((F.col("n") == k).cast("bigint")).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)), F.count("*").alias("kinds"))
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    best = [k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}")) for k in (1, 2, 3)]
    # Where the counts of counts can't tell, half of the most.
    cut = [F.when(d.isNull(), 0.5 * k).otherwise(F.greatest(F.lit(0.1 * k), F.least(F.lit(1.0 * k), d))).alias(f"d{k}") for k, d in enumerate(best, 1)]
    # One row for each order and language; written, so that Spark knows its size and deals no n-grams by language.
    discounts = written(times.select("order", "lang", "kinds", *cut), "discounts")
    probabilities: list[DataFrame] = []
    contexts: list[DataFrame] = []
    for order, table in enumerate(tables, 1):
        context = F.expr("0L") if order == 1 else F.expr("shiftrightunsigned(key, 16)")
        known = table.withColumn("context", context).join(discounts.filter(F.col("order") == order).drop("order"), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        sums = written(known.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("bo")), f"contexts{order}")
        both = known.join(sums, ["lang", "context"])
        if order == 1:
            lower = F.lit(1.0) / (F.col("kinds") + 1)
        else:
            last = (1 << 16 * (order - 1)) - 1
            shorter = probabilities[-1].select("lang", F.col("key").alias("shorter"), F.col("p").alias("shorter_p"))
            both = both.withColumn("shorter", F.col("key").bitwiseAND(F.lit(last))).join(shorter, ["lang", "shorter"])
            lower = F.col("shorter_p")
            contexts.append(sums.select("lang", F.col("context").alias("key"), "bo"))
        probabilities.append(written(both.select("lang", "key", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("bo") * lower).alias("p")), f"order{order}"))
    return probabilities, contexts


def train(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The model: (lang, key, n, p) of each order from 1, and (lang, key, bo) of the contexts of each order from 2."""
    return _estimates(written(counted(docs), "grams"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        known = {x: _seed(x) for x in set(langs)}
        seeds = np.fromiter((known[x] for x in langs), np.uint64, len(langs))
        hashes = _hashes(batch.column(1).to_numpy().view(np.uint64), seeds)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(2)], ["hash", "value"])


def core(grams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log probabilities of the most frequent of grams (lang, key, n, p), whole levels of counts, at most so many."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = grams.groupBy(level.alias("level")).agg(F.count("*").alias("m")).orderBy(F.desc("level")).collect()  # at most 512 rows
    total, least = 0, None
    for row in levels:
        total += row.m
        if total > most:
            break
        least = row.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = grams.filter(level >= least).select("lang", "key", F.log("p").alias("value"))
    found = rows.mapInArrow(_hashed, "hash bigint, value double").toArrow()
    hashes = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column(1).to_numpy()[order]


class _opened:
    """A core with a directory by the first bits of its hashes."""

    def __init__(self, found: tuple[np.ndarray, np.ndarray]):
        self.hashes, self.values = found
        bits = max(1, len(self.hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Values of the hashes, not a number where there is none."""
        out = np.full(len(hashes), np.nan)
        cell = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[cell], self.starts[cell + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.hashes[here] == hashes[left]
            out[left[same]] = self.values[here[same]]
            at[left] += 1
            left = left[~same]
            left = left[at[left] < end[left]]
        return out


def _backed_off(needed: DataFrame, model: tuple[list[DataFrame], list[DataFrame]]) -> DataFrame:
    """(lang, key, value) of each of needed (lang, key): its log probability by the whole model."""
    probabilities, contexts = model
    value = F.lit(_UNSEEN)
    for order in range(1, ORDER + 1):
        last = F.col("key") if order == ORDER else F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1))
        needed = needed.withColumn("part", last)
        needed = needed.join(probabilities[order - 1].select("lang", F.col("key").alias("part"), F.log("p").alias(f"p{order}")), ["lang", "part"], "left")
        if order > 1:
            needed = needed.withColumn("part", F.shiftrightunsigned("part", 16))
            needed = needed.join(contexts[order - 2].select("lang", F.col("key").alias("part"), F.log("bo").alias(f"b{order}")), ["lang", "part"], "left")
            value = value + F.coalesce(F.col(f"b{order}"), F.lit(0.0))
        value = F.coalesce(F.col(f"p{order}"), value)
    return needed.select("lang", "key", value.alias("value"))


def _repeat_words(words: np.ndarray) -> int:
    found = windows(words, 3)
    if len(found) < 2:
        return 0
    order = np.sort(found)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(found, twice))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen, twice = set(), 0
    for line in text.split("\n"):
        if line in seen:
            twice += 1
        elif line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            seen.add(line)
    return twice


def _assess(data: np.ndarray, offsets: np.ndarray, langs: list[str], known_logs: _opened) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each row, the last the sum of the log probabilities that the core knows; and row, key and number of the other n-grams."""
    rows = len(offsets) - 1
    lo = int(offsets[0])
    part, at = data[lo : int(offsets[-1])], offsets - lo
    of = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    words, first = word_hashes(data, offsets)
    counts = [np.diff(first), of(((part & 0xC0) != 0x80) & ~SPACE[part]), of(_SYMBOLS[part])]
    dup, repeat = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for k in range(rows):
        dup[k] = _dup_lines(part[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
        repeat[k] = _repeat_words(words[first[k] : first[k + 1]])
    known = {x: _seed(x) for x in set(langs)}
    sums = np.zeros(rows)
    others: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (a, b) in enumerate(_pieces(data, offsets)) if rows == 1 else [(0, (offsets[0], offsets[-1]))]:
        bounds = offsets if rows > 1 else np.array([a, b])
        padded, begins = _codes(data, bounds)
        if rows == 1 and k:  # a piece goes on from the codes before it
            before, _ = _codes(data, np.array([_aligned(data, max(int(offsets[0]), a - 4 * ORDER)), a]))
            padded[: ORDER - 1] = before[-(ORDER - 1) :]
        keys, own = _keys(padded), np.diff(begins) - (ORDER - 1)
        if not own.sum():
            continue
        take = np.arange(own.sum()) + (ORDER - 1) * np.repeat(np.arange(rows), own)
        seeds = np.repeat(np.array([known[x] for x in langs], np.uint64), own)
        keys, of_row = keys[take], np.repeat(np.arange(rows), own)
        named = pa.array((keys ^ seeds).view(np.int64)).dictionary_encode()  # each n-gram is looked up once
        logs = known_logs(mix(named.dictionary.to_numpy().view(np.uint64)))[named.indices.to_numpy()]
        lost = np.isnan(logs)
        if lost.any():
            others.append((of_row[lost], keys[lost]))
            logs[lost] = 0.0
        sums += np.bincount(of_row, logs, rows)
    row, key, n = _tallied(others)
    return [*counts, dup, repeat, of((part & 0xC0) != 0x80), sums], row, key, n


def _tallied(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) in order of rows, and how often each occurs."""
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, key = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(row)))


def _aligned(data: np.ndarray, at: int) -> int:
    """The begin of the character that at is in."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _pieces(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """One text in pieces of whole characters."""
    a, end = int(offsets[0]), int(offsets[-1])
    while a < end:
        b = end if end - a <= size else _aligned(data, a + size)
        yield a, b
        a = b


def assessed(docs: DataFrame, held, carry: list[str], prefix: str = "") -> DataFrame:
    """The carried columns of docs, with FIGURES of each text; their names get the prefix. held: a broadcast of what core() returns.

    row is unique; model names what scores the text; rest lists the n-grams that the core does not hold."""
    rows = docs.select(*carry, _name(1 - half(F.col("text")), F.col("lang")).alias("__model"), F.col("text").alias("__text"))
    last = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, number = _opened(held.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, data, offsets, models in _texts(batch, last + 1, last):
                n = len(offsets) - 1
                found, row, key, times = _assess(data, offsets, models, opened)
                arrays = [batch.column(k).slice(i, n) for k in range(last + 1)]
                arrays += [pa.array(x.astype(np.int64)) for x in found[:6]] + [pa.array(found[6], pa.float64()), pa.array(np.arange(number, number + n))]
                ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                arrays += [pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))]
                number += n
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = [*docs.select(*carry).schema.fields, *T.StructType.fromDDL(", ".join(f"{prefix}{name} {kind}" for name, kind in FIGURES)).fields]
    names = [f.name for f in fields]
    return rows.mapInArrow(run, T.StructType(fields))


def base_failed() -> Column:
    words, repeat = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (repeat * 100 > words * 50)


def bands(scored: DataFrame) -> DataFrame:
    """(__band_lang, __low, __high) in nats a character, of each language that has a text which passes the base rules."""
    level = F.round(F.col("nll") * 1000).cast("int")
    counts = scored.filter(~base_failed()).groupBy(lang_key(F.col("lang")).alias("__band_lang"), level.alias("level")).agg(F.count("*").alias("n"))
    along = Window.partitionBy("__band_lang")  # one row for each thousandth of a nat
    ranked = counts.withColumn("upto", F.sum("n").over(along.orderBy("level"))).withColumn("all", F.sum("n").over(along))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("level"))) / 1000
    marks = ranked.groupBy("__band_lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    low = F.col("q2") - F.greatest(F.lit(LEAST_NATS), (F.col("q2") - F.col("q1")) * SPREAD)
    high = F.col("q2") + F.greatest(F.lit(LEAST_NATS), (F.col("q3") - F.col("q2")) * SPREAD)
    return marks.select("__band_lang", low.alias("__low"), high.alias("__high"))


def _scored(stats: DataFrame, model: tuple[list[DataFrame], list[DataFrame]], prefix: str) -> DataFrame:
    """(row, lang, STATS, nll) of each of the assessed rows, in nats a character."""
    plain = stats.select("lang", *(F.col(prefix + name).alias(name) for name, _ in FIGURES))
    rest = plain.select("row", F.col("model").alias("lang"), F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", "lang", F.col("x.rest").alias("key"), F.col("x.times").alias("m"))
    values = _backed_off(rest.select("lang", "key").distinct(), model)
    sums = rest.join(values, ["lang", "key"]).groupBy("row").agg(F.sum(F.col("m") * F.col("value")).alias("other"))
    nll = F.when(F.col("chars") > 0, -(F.col("known") + F.coalesce(F.col("other"), F.lit(0.0))) / F.col("chars")).otherwise(0.0)
    return plain.drop("rest", "times").join(sums, "row", "left").select("row", "lang", *STATS, F.round(nll, 9).alias("nll"))


def _judged(docs: DataFrame, carry: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """The assessed rows, and (row, lang, STATS, nll, base_failed, kept) of each."""
    model = train(docs)
    held = docs.sparkSession.sparkContext.broadcast(core(model[0][-1], CORE))
    stats = written(assessed(docs, held, carry, prefix), "stats")
    scored = written(_scored(stats, model, prefix), "scored")
    # Written, so that Spark knows its size: one row for each language need not bring a language to one task.
    limits = written(bands(scored), "bands")
    judged = scored.join(limits, lang_key(F.col("lang")) == limits["__band_lang"], "left").withColumn("base_failed", base_failed())
    inside = F.coalesce(F.col("nll").between(F.col("__low"), F.col("__high")), F.lit(False))
    return stats, judged.withColumn("kept", ~F.col("base_failed") & inside).drop("__band_lang", "__low", "__high")


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the STATS, nll, base_failed, kept) of each row of docs (doc_id, text, lang)."""
    stats, judged = _judged(docs, ["doc_id", "lang"], "")
    return stats.select("doc_id", "row").join(judged, "row").drop("row")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep."""
    stats, judged = _judged(docs, docs.columns, "quality__")
    out = written(judged.filter(~F.col("kept")).select(F.col("row").alias("quality__row")), "rejected")
    return stats.join(out, "quality__row", "left_anti").select(*docs.columns)
