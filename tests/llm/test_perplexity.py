import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.llm import perplexity as P
from tests.llm.conftest import prose
from tests.llm.test_neardup import WORD

SPACES = "\x20\t\n\x0b\x0c\r"


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for k in range(len(words) - 2):
        places[tuple(words[k : k + 3])].append(k)
    covered = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(3)}
    seen, twins = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            twins += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twins, len(covered)


def units(text):
    """The text as UTF-16 units, white space as one."""
    text = "".join(" " if c in SPACES else c for c in text or "").encode("utf-16-le")
    return tuple(int.from_bytes(text[k : k + 2], "little") for k in range(0, len(text), 2))


class KneserNey:
    """Modified Kneser-Ney of one language's texts, by dictionaries."""

    def __init__(self, texts, order=4):
        self.order = order
        tables = {order: Counter(g for t in texts for g in self.grams(t))}
        for n in range(order - 1, 0, -1):
            tables[n] = Counter(g[1:] for g in tables[n + 1])
        self.prob, self.weight = {}, {}
        for n in range(1, order + 1):
            own = tables[n]
            t = Counter(own.values())
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
            cut = {}
            for k in (1, 2, 3):
                cut[k] = max(0.1 * k, min(1.0 * k, k - (k + 1) * y * t[k + 1] / t[k])) if y is not None and t[k] else 0.5 * k
            by = defaultdict(list)
            for g, c in own.items():
                by[g[:-1]].append((g, c))
            for context, group in by.items():
                total = sum(c for _, c in group)
                self.weight[context] = sum(cut[min(c, 3)] for _, c in group) / total
                for g, c in group:
                    lower = 1 / (len(own) + 1) if n == 1 else self.prob[g[1:]]
                    self.prob[g] = (c - cut[min(c, 3)]) / total + self.weight[context] * lower

    def grams(self, text):
        padded = (2,) * (self.order - 1) + units(text)
        return [padded[k : k + self.order] for k in range(len(padded) - self.order + 1)]

    def log(self, gram):
        if gram in self.prob:
            return math.log(self.prob[gram])
        return -16.0 if len(gram) == 1 else math.log(self.weight.get(gram[:-1], 1.0)) + self.log(gram[1:])

    def nll(self, text):
        return -sum(map(self.log, self.grams(text))) / len(text) if text else 0.0


def brute(rows):
    """{index: (nll, base failed, kept)} of (text, lang, half)."""
    groups = defaultdict(list)
    for text, lang, part in rows:
        groups[lang, part].append(text or "")
    models = {key: KneserNey(texts) for key, texts in groups.items()}
    nothing, out, levels = KneserNey([]), [], defaultdict(list)
    for text, lang, part in rows:
        n, *_, repeat = stats(text)
        out.append((models.get((lang, 1 - part), nothing).nll(text or ""), n < 50 or 100 * repeat > 50 * n))
        if not out[-1][1]:
            levels[lang].append(round(out[-1][0], 3))
    limits = {}
    for lang, values in levels.items():
        q1, q2, q3 = (sorted(values)[math.ceil(len(values) * share) - 1] for share in (0.25, 0.5, 0.75))
        limits[lang] = q2 - max(0.05, 8 * (q2 - q1)), q2 + max(0.05, 8 * (q3 - q2))
    return [(nll, failed, not failed and limits[lang][0] <= nll <= limits[lang][1]) for (nll, failed), (_, lang, _) in zip(out, rows, strict=True)]


def expected(docs):
    rows = docs.select("doc_id", "text", "lang", P.half(F.col("text")).alias("half")).collect()
    return {r.doc_id: found for r, found in zip(rows, brute([(r.text, r.lang, r.half) for r in rows]), strict=True)}


def test_odd_rows(odd, none):
    found = P.quality(odd).collect()
    rows = odd.collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted((str(r.doc_id), *stats(r.text)) for r in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert P.quality(none).count() == 0
    kept = P.filtered(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in found)


@pytest.mark.parametrize("most", [P.CORE, 200, 0])
def test_figures_equal_brute_force_with_any_core(spark, monkeypatch, most):
    monkeypatch.setattr(P, "CORE", most)
    texts = [("en", prose(k, 60) + (" \U0001f600\U0001f601é" if k % 3 else "")) for k in range(12)] + [("de", "der die das " * 30 + prose(90, 20)), ("de", prose(91, 60)), (None, "a bb  ccc\tdd\n" * 9), ("fr", ""), ("en", None)]
    docs = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
    by = expected(docs)
    for r in P.quality(docs).collect():
        nll, failed, kept = by[r.doc_id]
        assert r.nll == pytest.approx(nll, abs=1e-7) and (r.base_failed, r.kept) == (failed, kept)


def test_long_text_in_pieces(spark, monkeypatch):
    text = prose(1, 3000) + " é\U0001f600"
    probabilities, _ = P.train(spark.createDataFrame([(text, "en")], "text string, lang string"))
    opened = P._opened(P.core(probabilities[-1], 3000))
    model = probabilities[-1].first().lang
    data = np.frombuffer(text.encode(), np.uint8)
    whole = P._assess(data, np.array([0, len(data)]), [model], opened)
    assert len(whole[2])  # something is left to join
    monkeypatch.setattr(P._pieces, "__defaults__", (997,))
    pieces = P._assess(data, np.array([0, len(data)]), [model], opened)
    for a, b in zip([*whole[0], *whole[1:]], [*pieces[0], *pieces[1:]], strict=True):
        assert a == pytest.approx(b)


def salad(k):
    x, out = k + 1, []
    for _ in range(120):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(str((x >> 8) % 1_000_000))
    return " ".join(out)


def shuffled(text):
    """The letters of each word backwards and words of all lengths glued to others."""
    return " ".join(w[::-1] for w in text.split()[::-1])


ENGLISH = "the house stands near a small river where old trees grow and people walk every day to meet their friends under warm light".split()
GERMAN = "das haus steht nahe einem kleinen fluss wo alte bäume wachsen und menschen jeden tag gehen um ihre freunde zu treffen".split()


def sentences(words, k, n=90):
    x, out = k * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(words[(x >> 16) % len(words)])
    return " ".join(out)


def test_bands_reject_junk_and_keep_prose(spark):
    rows = [(k, sentences(ENGLISH, k), "en") for k in range(300)] + [(k, sentences(GERMAN, k), "de") for k in range(400, 600)]
    junk = [(1000, "".join(chr(0x4E00 + k * 37 % 9000) + " " for k in range(80)), "en"), (1001, salad(3), "en"), (1002, sentences(GERMAN, 7), "en"), (1003, sentences(ENGLISH, 8), "de"), (1004, shuffled(sentences(ENGLISH, 9)), "en")]
    schema = "doc_id bigint, text string, lang string"
    found = {r.doc_id: r for r in P.quality(spark.createDataFrame(rows + junk, schema)).collect()}
    assert sum(found[k].kept for k, *_ in rows) >= 0.98 * len(rows)
    assert not any(found[k].kept or found[k].base_failed for k, *_ in junk)
    # Texts of other languages change nothing.
    alone = P.quality(spark.createDataFrame([r for r in rows + junk if r[2] == "en"], schema)).collect()
    assert all(r.kept == found[r.doc_id].kept and r.nll == pytest.approx(found[r.doc_id].nll, abs=1e-9) for r in alone)


def test_verdicts_on_a_table_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by = expected(docs)
    found = P.quality(docs).collect()
    assert len(found) == len(by)
    for r in found:
        nll, failed, kept = by[r.doc_id]
        assert r.nll == pytest.approx(nll, abs=1e-7) and (r.base_failed, r.kept) == (failed, kept)


def test_grams_are_counted_by_spark(spark):
    docs = spark.createDataFrame([("abcde", "en"), ("abcde", None), ("", "en"), ("bcdef", "en")], "text string, lang string").repartition(2)
    key = lambda g: sum(ord(c) << 16 * (3 - k) for k, c in enumerate(g))
    counts = Counter()
    for r in docs.select("text", "lang", P.half(F.col("text")).alias("half")).collect():
        for k in range(len(r.text)):
            counts[f"{r.half}" + ("l" + r.lang if r.lang else ""), key(("\x02" * 3 + r.text)[k : k + 4])] += 1
    assert {(r.lang, r.key): r.n for r in P.counted(docs).collect()} == dict(counts)
