"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that the patterns label.

The values that the patterns find are the labelled credentials. For each kind a bounded sample of distinct values (the first SAMPLE by MD5,
of at most SAMPLE_CHARS characters) makes a prefix tree over character classes; states whose outgoing and final frequencies agree within
the Hoeffding bound, all the way down, are merged from the root on. Characters of a class have the frequencies of the state they leave, drawn towards
those of the class in the whole automaton (DRAWN), so that values are scored by their format and not by the characters that few labelled values had.
Where a state knows no such step, or may not end there, an unseen event of that state is charged for (one in its arrivals and one): other lengths are less
likely, not impossible. Classes that no labelled value of the kind has are impossible.

Candidates are the runs of the characters and the least length that labelled values have, and where a run is none, its parts between dots and equals signs.
Each is scored, of whatever length: its likelihood as one of the formats against its likelihood as running text, whose character frequencies are counted over
all documents. It passes when that ratio makes a credential likely (SURE, against as many candidates as there are for each labelled value) and is, by
character, no lower than all but LEAST of the labelled values have it when they are scored by an automaton that was learned without them (FOLDS).
Spans that pass are added as kind "format"; spans of the patterns always stay.

A null text is an empty one and has no spans; texts are scanned whole; repeated rows are scanned alike; without two different labelled credentials of a
kind nothing is added by it; an empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import statistics
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


KINDS = ("assign", "access", "hex", "format")
SAMPLE, SAMPLE_CHARS = 1000, 128
ALPHA = 0.01
#: Odds for a credential that a candidate must reach.
SURE = 99.0
#: Share of the labelled values that may score below the limit, and nats (times the root of its length) by which a candidate may lie below it, as few values set it.
LEAST, SLACK = 0.01, 1.0
#: Parts of the labelled values, each scored by what the others teach; weight of a class's own frequencies in a state, in characters.
FOLDS, DRAWN = 5, 8.0
#: Deviations that LEAST of a normal tail lies below, for about ten values.
TAIL = 2.8
#: Decisions that a task keeps, as words recur.
KEPT = 1 << 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_PART = re.compile(r"[A-Za-z0-9+/_-]{8,}=*")
_LETTERS_OF_HEX = frozenset("0123456789abcdef")
#: Characters of each class; signs are classes of their own.
_OF_CLASS = {"h": "0123456789abcdef", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz"}

_NAMES = ("passw", "secret", "token", "api")

Span = tuple[int, int, str, int]


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, start of the value) by start, then kind as listed."""
    found = []
    small = text.lower()
    if any(word in small for word in _NAMES):  # else the pattern can't match
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for a, b in _runs(text):  # the other two match within these only
        found += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text, a, b)]
        found += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text, a, b)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs that may be credentials and touch no span, without the dots around them. spans by start."""
    at, reach = 0, 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= a:
            while a < b and text[a] == ".":
                a += 1
            while a < b and text[b - 1] == ".":
                b -= 1
            if b - a >= 8:
                yield a, b


def classes(value: str) -> str:
    """One symbol for each character: h in words of lower-case hex, U in words without lower case, else d, l, U; signs are themselves."""
    letters = set(value)
    if not any(c.isalpha() for c in letters):
        table = "d", "l", "U"
    elif letters <= _LETTERS_OF_HEX:
        return "h" * len(value)
    elif not any("a" <= c <= "z" for c in letters):
        table = "U", "l", "U"
    else:
        table = "d", "l", "U"
    return "".join(table[0] if "0" <= c <= "9" else table[1] if "a" <= c <= "z" else table[2] if "A" <= c <= "Z" else c for c in value)


class Automaton:
    """A probabilistic automaton over classes, with the characters each state was left by. Plain lists and dicts, so that it travels."""

    def __init__(self, values: dict[str, int]):
        self.arrive, self.final, self.next, self.count = [0], [0], [{}], [{}]
        for value, times in sorted(values.items()):
            at = 0
            self.arrive[0] += times
            for symbol in classes(value):
                if symbol not in self.next[at]:
                    self.next[at][symbol] = self._state()
                self.count[at][symbol] = self.count[at].get(symbol, 0) + times
                at = self.next[at][symbol]
                self.arrive[at] += times
            self.final[at] += times
        self._merge()
        seen: dict[tuple[int, str], Counter] = {}
        pool: dict[str, Counter] = {}
        for value, times in values.items():
            at = 0
            for symbol, char in zip(classes(value), value, strict=True):
                seen.setdefault((at, symbol), Counter())[char] += times
                pool.setdefault(symbol, Counter())[char] += times
                at = self.next[at][symbol]
        self.pool = {symbol: {c: (found[c] + 1) / (sum(found.values()) + len(_OF_CLASS.get(symbol, symbol))) for c in _OF_CLASS.get(symbol, symbol)} for symbol, found in pool.items()}
        self.chars: dict[tuple[int, str], dict[str, float]] = {}
        for (at, symbol), found in seen.items():
            total = sum(found.values()) + DRAWN
            self.chars[at, symbol] = {c: (found[c] + DRAWN * p) / total for c, p in self.pool[symbol].items()}
        lows: dict[int, float] = {}
        for value in values:
            score = self.log_likelihood(value)
            lows[len(value)] = min(score, lows.get(len(value), score))
        self.lows = lows

    def _state(self) -> int:
        for x, empty in ((self.arrive, 0), (self.final, 0)):
            x.append(empty)
        self.next.append({})
        self.count.append({})
        return len(self.arrive) - 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        if not n or not m:
            return False
        return abs(f / n - g / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if self._differ(self.final[a], self.arrive[a], self.final[b], self.arrive[b]):
                return False
            for symbol in {*self.next[a], *self.next[b]}:
                if self._differ(self.count[a].get(symbol, 0), self.arrive[a], self.count[b].get(symbol, 0), self.arrive[b]):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, a: int, b: int) -> list[int]:
        """Adds the tree below b to a; the states that got more."""
        todo, changed = [(a, b)], []
        while todo:
            a, b = todo.pop()
            changed.append(a)
            self.arrive[a] += self.arrive[b]
            self.final[a] += self.final[b]
            for symbol, child in self.next[b].items():
                self.count[a][symbol] = self.count[a].get(symbol, 0) + self.count[b][symbol]
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], child))
                else:
                    self.next[a][symbol] = child
        return changed

    def _merge(self) -> None:
        # Kept states by age; those before ``at`` have no step to a state that isn't kept.
        red, place, at = [0], {0: 0}, 0
        while at < len(red):
            parent = red[at]
            symbol = next((s for s in sorted(self.next[parent]) if self.next[parent][s] not in place), None)
            if symbol is None:
                at += 1
                continue
            state = self.next[parent][symbol]
            for kept in red:
                if self._compatible(kept, state):
                    self.next[parent][symbol] = kept
                    at = min([at, *(place[s] for s in self._fold(kept, state) if s in place)])
                    break
            else:
                place[state] = len(red)
                red.append(state)

    def log_likelihood(self, value: str, symbols: str | None = None, unseen: bool = False) -> float | None:
        """None where the automaton has no such path; with ``unseen``, only where it has no such class at all. symbols: the value's classes, if known."""
        at, score = 0, 0.0
        for symbol, char in zip(symbols or classes(value), value, strict=True):
            to = self.next[at].get(symbol)
            if to is not None:
                score += math.log(self.count[at][symbol] / self.arrive[at]) + math.log(self.chars[at, symbol][char])
                at = to
            elif unseen and symbol in self.pool:
                score += math.log(self.pool[symbol][char]) - math.log(self.arrive[at] + 1)
            else:
                return None
        if self.final[at]:
            return score + math.log(self.final[at] / self.arrive[at])
        return score - math.log(self.arrive[at] + 1) if unseen else None


def nats_above(machine: Automaton, background: dict[str, float], value: str, symbols: str | None = None) -> float | None:
    score = machine.log_likelihood(value, symbols, unseen=True)
    return None if score is None else score - sum(background[c] for c in value)


def held_out_limit(values: list[str], background: dict[str, float]) -> float | None:
    """Least nats a character, but for LEAST of the values, each scored by an automaton of the other folds. None below two values.

    Few values show no tail: the limit is never above the mean less TAIL deviations.
    """
    order = sorted(values, key=lambda v: (hashlib.md5(v.encode()).digest(), v))
    folds = min(FOLDS, len(order))
    if folds < 2:
        return None
    found = []
    for fold in range(folds):
        machine = Automaton({v: 1 for k, v in enumerate(order) if k % folds != fold})
        nats = ((v, nats_above(machine, background, v)) for v in order[fold::folds])
        found += [n / len(v) for v, n in nats if n is not None]
    if len(found) < 2:
        return None
    return min(sorted(found)[int(LEAST * len(found))], statistics.mean(found) - TAIL * statistics.stdev(found))


class Model:
    """Automata by kind, log frequencies of running text, nats that a candidate needs, and least nats a character by kind."""

    def __init__(self, automata: dict[str, Automaton], background: dict[str, float], margin: float, limits: dict[str, float]):
        self.automata, self.background, self.margin, self.limits = automata, background, margin, limits
        self.known: dict[str, bool] = {}

    def ratio(self, kind: str, value: str, symbols: str | None = None) -> float | None:
        """Nats by which the kind's automaton explains the value better than running text does."""
        return nats_above(self.automata[kind], self.background, value, symbols)

    def accepts(self, value: str) -> bool:
        if value not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            symbols = classes(value)
            found = ((self.ratio(kind, value, symbols), limit) for kind, limit in self.limits.items())
            self.known[value] = any(nats is not None and nats >= max(self.margin, limit * len(value) - SLACK * math.sqrt(len(value))) for nats, limit in found)
        return self.known[value]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        chars: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                spans = base_spans(text)
                found["labels", ""] += len(spans)
                for _, end, kind, value in spans:
                    if end - value <= SAMPLE_CHARS:
                        found[kind, text[value:end]] += 1
                others = [text[a:b] for a, b in candidates(text, spans)]
                found["candidates", ""] += len(others)
                chars.update("".join(others))
        found.update({("char", char): n for char, n in chars.items()})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "value", "n"])


def learn(docs: DataFrame) -> Model:
    """An automaton for each kind that labels a value, log frequencies of characters in candidates that no pattern finds, and the limits."""
    spark = docs.sparkSession
    found = docs.select("text").mapInArrow(_labelled, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.md5("value"), "value"))
    rows = found.withColumn("place", place).filter(F.col("place") <= SAMPLE).select("kind", "value", "n").collect()
    # A value counts once however often it is repeated: its format is to be learned.
    automata = {kind: Automaton(values) for kind in KINDS if (values := {r.value: 1 for r in rows if r.kind == kind})}
    chars = Counter({r.value: r.n for r in rows if r.kind == "char"})
    times = Counter({r.kind: r.n for r in rows if r.kind in ("labels", "candidates")})
    total = sum(chars.values())
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
    background = {c: math.log((chars[c] + 1) / (total + len(alphabet))) for c in alphabet}
    model = Model(automata, background, math.log(SURE * max(1.0, times["candidates"] / max(1, times["labels"]))), {})
    for kind in automata:
        limit = held_out_limit([r.value for r in rows if r.kind == kind], background)
        if limit is not None:
            model.limits[kind] = limit
    return model


def _sent(docs: DataFrame, model: Model):
    """The model as bytes that bring their classes along: executors need no copy of this package."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))


def all_spans(text: str, model: Model) -> list[Span]:
    spans = base_spans(text)
    added = []
    for a, b in candidates(text, spans) if model.limits else ():
        if model.accepts(text[a:b]):
            added.append((a, b, "format", a))
        elif "." in (value := text[a:b]) or "=" in value:
            added += [(*m.span(), "format", m.start()) for m in _PART.finditer(text, a, b) if model.accepts(m[0])]
    return sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) of each row of docs (doc_id, text)."""
    sent = _sent(docs, learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                spans = all_spans(text or "", model)
                kinds = Counter(s[2] for s in spans)
                base = joined([s for s in spans if s[2] != "format"])
                row = (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(spans), kinds["format"])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.StringType() if n in ("base_sha256", "spans") else T.LongType()) for n in names[1:])]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every secret's value replaced by its kind."""
    out, at = [], 0
    for start, end, kind in sorted((value, end, kind) for _, end, kind, value in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret masked in the text; n_chars, where there is one, counts the new text. A null text stays null."""
    sent = _sent(docs, learn(docs))
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [t and (masked(t, spans) if (spans := all_spans(t, model)) else t) for t in old]
            columns = list(batch.columns)
            columns[text] = pa.array(new, batch.column(text).type)
            if chars >= 0:
                kept = batch.column(chars).to_pylist()
                columns[chars] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)], batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
