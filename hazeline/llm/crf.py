"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line is described by its own figures, those of the lines before and after it, and how the text repeats itself; each figure falls into one of a few fixed
ranges, and each range has a weight. Training lines take the label of their document, each document counting once. The chance of
good of every line (forward-backward), weighted by the line's length, is the document's figure; a logistic curve turns it into a probability of label 1.

It is fitted on whole texts of a sample of labelled documents outside the held-out fifth: those first by MD5 of the id, TRAIN_DOCS documents and TRAIN_ROWS lines
of text at most. Everything else covers all texts, whole.
A null text is empty; a text without a word has the figure 0; repeated labels with one value count once, and documents
labelled both ways aren't learned from; without labels of both kinds the score is the share of label 1 (0.5 without any). A null id is held out.
Repeated rows score alike; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm.arrays import BLOCK, SPACE, mix, slices, utf8, word_bounds, word_hashes

TRAIN_DOCS = 5000
THRESHOLD = 0.3
STEPS, RATE, SHRINK = 80, 0.15, 1e-3
#: Lines of the sample in all; documents are taken whole or not at all.
TRAIN_ROWS = 200_000
#: Chains longer than this are multiplied out by doubling instead of line by line.
LOOP = 64

#: Upper ends of the ranges of each figure of a line.
EDGES = {
    "upper": (0.01, 0.03, 0.06, 0.12, 0.3, 0.6, 0.9),
    "symbols": (0.0, 0.002, 0.01, 0.03, 0.06, 0.12),
    "calls": (0.0, 0.02, 0.1, 0.3, 0.7),
    "digits": (0.0, 0.01, 0.05, 0.2),
    "points": (0.0, 0.03, 0.07, 0.12, 0.2, 0.4),
    "pipes": (0.0, 0.05, 0.2, 0.5),
    "letters": (2.5, 3.5, 4.2, 4.8, 5.5, 6.5, 9.0),
    "words": (0, 1, 2, 4, 8, 16, 40, 120, 400),
    "again": (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "twin": (0.0,),
    "ended": (0.0,),
}
#: Figures of the whole text.
TEXT_EDGES = {"twins": (0.0, 0.05, 0.2, 0.5), "lines": (1, 3, 8, 20, 60), "text_words": (5, 20, 50, 100, 300, 1000, 4000), "text_again": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75), "loops": (0.0, 0.02, 0.1, 0.3, 0.6)}
_OWN = len(EDGES)
_COUNTS = [len(e) + 2 for e in EDGES.values()] * 3 + [len(e) + 2 for e in TEXT_EDGES.values()]  # the last range: there is no such line
_FIRST = np.concatenate([[0], np.cumsum(_COUNTS)])
N_WEIGHTS = int(_FIRST[-1])


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_SYMBOLS, _CALLS, _DIGITS, _POINTS, _PIPES, _ENDS = (_flags(x) for x in (b"#*$%&|<>@^~_=+\\{}[]", b"!?", b"0123456789", b".,;:'\"-()", b"|", b".!?:;\"')"))


def _again(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """How many values of each group equal another one of their group, beyond the first."""
    keyed = mix(values ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    return np.bincount(group[order][1:][same], minlength=groups)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def described(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts between the cuts: weight numbers (lines x figures), characters of each line, and lines of each text. Lines without a word are left out."""
    base = int(cuts[0])
    part = data[base : int(cuts[-1])]
    texts = len(cuts) - 1
    breaks = np.flatnonzero(part == 10) + 1
    edges = np.unique(np.concatenate([cuts - base, breaks]))
    starts, ends, _ = word_bounds(data, cuts)
    hashes, _ = word_hashes(data, cuts, lower=True)
    first = np.searchsorted(starts - base, edges)
    n_words = np.diff(first)
    used = np.flatnonzero(n_words > 0)
    if not len(used):
        return np.zeros((0, len(_COUNTS)), np.int64), np.zeros(0), np.zeros(texts, np.int64)
    text_of_edge = np.searchsorted(cuts - base, edges[:-1], "right") - 1
    text = text_of_edge[used]
    line_of_word = np.repeat(np.arange(len(used)), n_words[used])
    text_of_word = text[line_of_word]
    n_words = n_words[used]

    def count(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags[part], dtype=np.int64)])[edges])[used]

    lead = (part & 0xC0) != 0x80
    chars = np.diff(np.concatenate([[0], np.cumsum(lead & ~SPACE[part], dtype=np.int64)])[edges])[used]
    wide = np.diff(np.concatenate([[0], np.cumsum(part >= 0xC0, dtype=np.int64)])[edges])[used]
    upper = count(_UPPER)
    at = np.arange(len(hashes), dtype=np.uint64) - np.repeat(np.concatenate([[0], np.cumsum(n_words)[:-1]]), n_words).astype(np.uint64)
    line_hash = mix(np.add.reduceat(mix(hashes + at * np.uint64(0xD6E8FEB86659FD93)), np.concatenate([[0], np.cumsum(n_words)[:-1]])))
    keyed = mix(line_hash ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, inverse, times = np.unique(keyed, return_inverse=True, return_counts=True)
    twin = times[inverse] > 1
    last_word = np.cumsum(n_words) - 1
    own = [
        _share(upper, upper + count(_LOWER) + wide), _share(count(_SYMBOLS), chars), _share(count(_CALLS), n_words), _share(count(_DIGITS), chars),
        _share(count(_POINTS), n_words), _share(count(_PIPES), n_words), _share(chars, n_words), n_words, _share(_again(hashes, line_of_word, len(used)), n_words),
        twin.astype(float), _ENDS[data[ends[last_word] - 1]].astype(float),
    ]
    per_text = lambda x: np.bincount(text, x, texts)
    lines, words = per_text(None), per_text(n_words)
    if len(hashes) > 2:
        triple = mix(hashes[:-2] + hashes[1:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[2:] * np.uint64(0xA0761D6478BD642F))
        inside = text_of_word[:-2] == text_of_word[2:]
        loops = _again(triple[inside], text_of_word[:-2][inside], texts)
    else:
        loops = np.zeros(texts)
    whole = [_share(per_text(twin), lines), lines, words, _share(_again(hashes, text_of_word, texts), words), _share(loops, words)]
    numbers = np.empty((len(used), len(_COUNTS)), np.int64)
    before, after = np.concatenate([[True], text[1:] != text[:-1]]), np.concatenate([text[1:] != text[:-1], [True]])
    for k, (value, ends_) in enumerate(zip(own, EDGES.values(), strict=True)):
        range_ = np.searchsorted(ends_, value, "left")
        none = len(ends_) + 1
        numbers[:, k] = range_
        numbers[:, _OWN + k] = np.where(before, none, np.roll(range_, 1))
        numbers[:, 2 * _OWN + k] = np.where(after, none, np.roll(range_, -1))
    for k, (value, ends_) in enumerate(zip(whole, TEXT_EDGES.values(), strict=True)):
        numbers[:, 3 * _OWN + k] = np.searchsorted(ends_, value, "left")[text]
    return numbers + _FIRST[:-1], chars.astype(float), lines.astype(np.int64)


def marginals(odds: np.ndarray, lines: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of good of each line, expected pairs (texts x 2 x 2) of labels bad 0, good 1. odds: log odds of the lines alone; pair: log factors of neighbours.

    Texts are taken by falling length, so that step t works on those with more than t lines.
    """
    if len(lines) and lines.max() > LOOP:
        return _marginals_by_doubling(odds, lines, pair)
    order = np.argsort(-lines, kind="stable")
    order = order[lines[order] > 0]
    begin = (np.cumsum(lines) - lines)[order]
    left = lines[order]
    factor = np.exp(pair)
    local = _local(odds)
    ahead, back = np.ones_like(local), np.ones_like(local)
    steps = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(steps), "left")  # texts with more than t lines
    for t in range(steps):
        at = begin[: active[t]] + t
        value = local[at] * (ahead[at - 1] @ factor if t else 1.0)
        ahead[at] = value / value.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        value = (local[at + 1] * back[at + 1]) @ factor.T
        back[at] = value / value.sum(1, keepdims=True)
    good = ahead * back
    good = good[:, 1] / good.sum(1)
    pairs = np.zeros((len(lines), 2, 2))
    for t in range(steps - 1):
        at = begin[: active[t + 1]] + t
        both = ahead[at][:, :, None] * factor * (local[at + 1] * back[at + 1])[:, None, :]
        pairs[order[: active[t + 1]]] += both / both.sum((1, 2), keepdims=True)
    return good, pairs, order


def _local(odds: np.ndarray) -> np.ndarray:
    return np.stack([1 / (1 + np.exp(np.clip(odds, -40, 40))), 1 / (1 + np.exp(-np.clip(odds, -40, 40)))], 1)


def _marginals_by_doubling(odds: np.ndarray, lines: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As marginals(): products of 2 x 2 matrices over all lines at once; the matrix at a text's end forgets what lies beyond."""
    factor, local = np.exp(pair), _local(odds)
    ends = np.cumsum(lines)[lines > 0]
    first, last = np.zeros(len(odds), bool), np.zeros(len(odds), bool)
    first[(np.cumsum(lines) - lines)[lines > 0]], last[ends - 1] = True, True
    forward = np.where(first[:, None, None], 1.0, factor) * local[:, None, :]
    backward = np.where(last[:, None, None], 1.0, factor * np.roll(local, -1, 0)[:, None, :])
    width = 1
    while width < lines.max():
        forward[width:], backward[:-width] = forward[:-width] @ forward[width:], backward[:-width] @ backward[width:]
        for x in (forward, backward):
            x /= x.sum((1, 2), keepdims=True)
        width *= 2
    ahead, back = forward.sum(1), backward.sum(2)
    ahead, back = ahead / ahead.sum(1, keepdims=True), back / back.sum(1, keepdims=True)
    good = ahead * back
    good = good[:, 1] / good.sum(1)
    at = np.flatnonzero(~last)
    both = ahead[at][:, :, None] * factor * (local[at + 1] * back[at + 1])[:, None, :]
    both /= both.sum((1, 2), keepdims=True)
    text = np.repeat(np.arange(len(lines)), lines)[at]
    pairs = np.stack([np.bincount(text, both[:, a, b], len(lines)) for a in (0, 1) for b in (0, 1)], 1).reshape(-1, 2, 2)
    return good, pairs, np.argsort(-lines, kind="stable")[: len(ends)]


def _odds(weights: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return weights[numbers].sum(1)


def figures(good: np.ndarray, chars: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    weight = np.bincount(text, chars, texts)
    return np.bincount(text, chars * good, texts) / np.maximum(weight, 1)


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-4, 1 - 1e-4)
    return np.log(x / (1 - x))


def fit(numbers: np.ndarray, chars: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> dict:
    """Weights, neighbour factors and the curve, from lines of labelled texts."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(numbers) or share in (0.0, 1.0):
        return {"share": share}
    text = np.repeat(np.arange(len(lines)), lines)
    y, each = labels[text], 1.0 / lines[text] / len(lines)
    seen = np.zeros((len(lines), 2, 2))
    seen[np.arange(len(lines)), labels.astype(int), labels.astype(int)] = np.maximum(lines - 1, 0)
    weights, pair = np.zeros(N_WEIGHTS), np.zeros((2, 2))
    state = [np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS), np.zeros((2, 2)), np.zeros((2, 2))]
    flat = numbers.ravel()
    for step in range(1, STEPS + 1):
        good, pairs, _ = marginals(_odds(weights, numbers), lines, pair)
        slope = np.bincount(flat, np.repeat((y - good) * each, numbers.shape[1]), N_WEIGHTS) - SHRINK * weights
        pair_slope = ((seen - pairs) / np.maximum(lines, 1)[:, None, None]).mean(0) - 10 * SHRINK * pair
        for value, grad, m, v in ((weights, slope, state[0], state[1]), (pair, pair_slope, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    good, _, _ = marginals(_odds(weights, numbers), lines, pair)
    x = _logit(figures(good, chars, text, len(lines)))
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of the curve
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((labels - p) * x).mean() - 1e-3 * a, (labels - p).mean()])
        h = np.array([[(w * x * x).mean() + 1e-3, (w * x).mean()], [(w * x).mean(), w.mean() + 1e-6]])
        step_ = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step_[0], -1, 1)), b + float(np.clip(step_[1], -1, 1))
    return {"share": share, "weights": weights, "pair": pair, "curve": (a, b)}


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the texts, and the row of each piece; a text over BLOCK bytes is cut at line ends, or anywhere in longer lines."""
    cuts, rows = [int(offsets[0])], []
    for k, end in enumerate(offsets[1:].tolist()):
        while end - cuts[-1] > BLOCK:
            found = np.flatnonzero(data[cuts[-1] + BLOCK // 2 : cuts[-1] + BLOCK] == 10)
            cuts.append(cuts[-1] + BLOCK // 2 + (int(found[-1]) + 1 if len(found) else BLOCK // 2))
            rows.append(k)
        cuts.append(end)
        rows.append(k)
    return np.array(cuts), np.array(rows)


def scores(column: pa.Array, model: dict) -> np.ndarray:
    data, offsets = utf8(column)
    out = []
    for i, j in slices(offsets):
        if "weights" not in model:
            out.append(np.full(j - i, model["share"]))
            continue
        cuts, rows = _segments(data, offsets[i : j + 1])
        weight, sums = np.zeros(j - i), np.zeros(j - i)
        for k in range(0, len(rows), max(1, len(rows) if cuts[-1] - cuts[0] <= 2 * BLOCK else 1)):
            upto = len(rows) if cuts[-1] - cuts[0] <= 2 * BLOCK else k + 1
            numbers, chars, lines = described(data, cuts[k : upto + 1])
            good, _, _ = marginals(_odds(model["weights"], numbers), lines, model["pair"])
            text = np.repeat(rows[k:upto], lines)
            weight += np.bincount(text, chars, j - i)
            sums += np.bincount(text, chars * good, j - i)
        a, b = model["curve"]
        out.append(1 / (1 + np.exp(-(a * _logit(sums / np.maximum(weight, 1)) + b))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from at most TRAIN_DOCS labelled documents that aren't held out, and TRAIN_ROWS lines."""
    known = labels.filter("quality IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    known = known.filter("label = other").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(TRAIN_DOCS)
    # At most TRAIN_DOCS rows of two numbers.
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", F.col("label").cast("int").alias("label"))), "doc_id")
    # Lines, one number for each document of the sample: those that fit are taken whole. A document that is repeated is learned from once.
    size = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    sizes = chosen.groupBy("doc_id").agg(F.max(size).cast("bigint").alias("size")).filter(F.col("size") <= TRAIN_ROWS)
    upto = F.sum("size").over(Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sizes.withColumn("upto", upto).filter(F.col("upto") <= TRAIN_ROWS).select("doc_id")
    chosen = chosen.join(F.broadcast(fitting), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                numbers, chars, lines = described(data, offsets[i : j + 1])
                begin = np.concatenate([[0], np.cumsum(lines)])
                rows = [slice(begin[k], begin[k + 1]) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([chars[r] for r in rows], pa.list_(pa.float64())),
                    pa.array([numbers[r].ravel() for r in rows], pa.list_(pa.int64())),
                ], ["doc_id", "label", "chars", "numbers"])

    found = chosen.select("doc_id", "text", "label").mapInArrow(run, T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("chars", T.ArrayType(T.DoubleType())), T.StructField("numbers", T.ArrayType(T.LongType())),
    ]))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.size("chars"), F.xxhash64("numbers")))
    rows = found.filter(F.size("chars") > 0).withColumn("k", first).filter("k = 1").select("doc_id", "label", "chars", F.transform("numbers", lambda x: x.cast("short")).alias("numbers")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lines = np.array([len(x) for x in rows.column("chars").to_pylist()], np.int64)
    return fit(flat("numbers").astype(np.int64).reshape(-1, len(_COUNTS)), flat("chars"), lines, rows.column("label").to_numpy().astype(float))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text); labels: (doc_id, quality)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), model.value), pa.float64())], ["doc_id", "score"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    scored = docs.select("doc_id", "text").mapInArrow(run, kind)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
