import hashlib
import re

import pytest

from hazeline.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    """The base rules as they are written."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def hexes(seed, n):
    return hashlib.sha512(str(seed).encode()).hexdigest()[:n]


def keys(seed):
    return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[int(c, 16) * 2 + k % 2] for k, c in enumerate(hexes(seed, 16)))


ODD = [
    "", "nothing here", "password=short", "PASSWORD: 'abcdefgh1'", "api-key=abcdefgh apikey=abcdefgh api_key = \"abc.def-gh\"", "ſecret=abcdefgh", "toKen=abcdefghi", "é token=ABCDEFGH\U0001f600 " + "a" * 31 + "g" + "b" * 40,
    "AKIA" * 6, "xAKIAABCDEFGHIJKLMNO", "AKIAABC", "secret=" + "f" * 64, "password=password=abcdefgh", "token:   =abcdefgh", "0" * 5000, "deadbeef" * 4 + "DEADBEEF" * 4 + "deadbeef" * 8,
]


@pytest.mark.parametrize("text", ODD)
def test_base_rules(text):
    assert S.joined(S.base_spans(text)) == plain(text)


@pytest.fixture(scope="module")
def labelled():
    words = [f"some plain words number {k} and internationalization or counterrevolutionaries there" for k in range(60)]
    return [f"{w} password={hexes(k, 18)} then {keys(k)} and token = \"{hexes(1000 + k, 40)}\" end" for k, w in enumerate(words)]


def test_automata_keep_the_format(labelled):
    values = {labelled[k][s[3] : s[1]]: 1 for k in range(60) for s in S.base_spans(labelled[k]) if s[2] == "access"}
    machine = S.Automaton(values)
    assert len(machine.lows) == 1 and machine.log_likelihood(keys(777)) is not None
    assert machine.log_likelihood(keys(777)[:-1]) is None and machine.log_likelihood("BKIA" + keys(777)[4:]) < machine.log_likelihood(keys(777)) - 2


def test_finds_what_no_pattern_finds(spark, labelled):
    hidden = hexes("hidden", 18)
    rows = list(enumerate([*labelled, f"no name before it: {hidden}.", "the word counterrevolutionaries internationalization, 4111111111111111 and some-hyphenated-long-words", None, "", "x" * 200_000]))
    found = {r.doc_id: r for r in S.scanned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    at = rows[60][1].index(hidden)
    assert found[60].spans == f"format:{at}:{at + 18}" and found[60].n_format == 1 and found[60].n_hex == 0
    for k, text in rows:
        base = plain(text or "")
        assert found[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        if k != 60:
            assert found[k].spans == base
    assert (found[0].n_assign, found[0].n_access, found[0].n_hex) == (2, 1, 1)


def test_odd_rows_and_masking(spark, odd, none, labelled):
    assert S.scanned(odd).count() == odd.count() and S.scanned(none).count() == 0
    masked = S.redacted(odd)
    assert masked.columns == odd.columns and sorted(str(r.text)[:50] for r in masked.collect()) == sorted(str(r.text)[:50] for r in odd.collect())
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(labelled)], "doc_id bigint, text string, n_chars bigint")
    for r in S.redacted(docs).collect():
        assert r.text == f"some plain words number {r.doc_id} and internationalization or counterrevolutionaries there password=[assign] then [access] and token = \"[assign]\" end"
        assert r.n_chars == len(r.text)
    assert S.redacted(none).count() == 0


def test_other_lengths_and_signs_than_the_labelled_ones(spark):
    """Values of a loop pass at lengths that no labelled value has; short ones and ones with dots are candidates as a whole."""
    mixed = lambda seed, n: "".join("QWXZK0123456789"[int(c, 16) % 15] for c in hashlib.sha512(f"m{seed}".encode()).hexdigest() * 2)[:n]
    lengths = [n for n in range(9, 60) if n not in (11, 33, 41)]
    dotted = lambda k: f"{hexes(k, 12)}.{hexes(k + 1, 12)}.{hexes(k + 2, 12)}"
    rows = [f"ordinary sentences contain sufficiently long expressions, something understandable: token={mixed(k, lengths[k % len(lengths)])} and secret: {dotted(5000 + k)} end" for k in range(400)]
    hidden = [mixed("a", 11), mixed("b", 33), mixed("c", 41), mixed("d", 140), dotted(9000)]
    rows += [f"it reads {value}. Nothing else about it, extraordinary.words here" for value in hidden]
    found = {r.doc_id: r.spans for r in S.scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)).collect()}
    for k, value in enumerate(hidden, 400):
        assert found[k] == f"format:9:{9 + len(value)}", value
    assert all(found[k] == plain(rows[k]) for k in range(400))


def model_of(values, words):
    chars = S.Counter("".join(words))
    total = sum(chars.values())
    background = {c: S.math.log((chars[c] + 1) / (total + 67)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."}
    machines = {kind: S.Automaton(dict.fromkeys(some, 1)) for kind, some in values.items()}
    limits = {kind: S.held_out_limit(some, background) for kind, some in values.items()}
    return S.Model(machines, background, S.math.log(S.SURE * 1000), {k: v for k, v in limits.items() if v is not None})


@pytest.mark.parametrize("learned", [11, 60, 400])
def test_unseen_values_of_a_format_pass_and_words_do_not(learned):
    """A few labelled values teach their format, not their characters; other lengths of the format pass too, words and addresses don't."""
    syllables = ["ta", "re", "mon", "ing", "sel", "con", "ver", "pre", "al", "ous", "ti", "ness", "ab", "ed"]
    words = ["".join(syllables[int(c, 16) % 14] for c in hexes(f"w{k}", 5)) for k in range(3000)]
    words += [f"www.{w}.com/{v}" for w, v in zip(words[:1500], words[1500:], strict=False)] + [f"{w}-{v}" for w, v in zip(words[:500], words[700:], strict=False)]
    words += [f"{1990 + k % 40}-{k % 12 + 1:02}-{k % 28 + 1:02}" for k in range(200)]
    model = model_of({"hex": [hexes(k, 40) for k in range(learned)], "access": [keys(k) for k in range(learned)]}, words)
    for make in (lambda k: hexes(k, 40), keys, lambda k: hexes(k, 28)):
        assert sum(model.accepts(make(f"new{k}")) for k in range(200)) >= 180
    assert sum(map(model.accepts, words)) < len(words) / 1000


def test_one_value_teaches_nothing():
    assert S.held_out_limit([], {}) is None and S.held_out_limit(["abcdef0123456789"], {}) is None


def test_planted_credential_of_another_length_is_found(spark):
    """In the given documents: 28 hex digits without a name, too short for the patterns."""
    from pathlib import Path

    table = "/root/testdata/sf0.01/documents.parquet"
    if not Path(table).exists():
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(table).select("doc_id", "text")
    planted = [hexes(f"planted{k}", 28) for k in range(10)]
    more = spark.createDataFrame([(-1 - k, f"It was written down as {v} on the last page.") for k, v in enumerate(planted)], "doc_id bigint, text string")
    found = S.scanned(docs.unionByName(more)).filter("n_format > 0").collect()
    assert sum(r.doc_id < 0 and r.spans == "format:23:51" for r in found) >= 9 and sum(r.doc_id >= 0 for r in found) <= 1


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Run from another folder: the driver finds the package by its own path, its Python workers don't."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.append({str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from hazeline.llm import secrets
docs = spark.createDataFrame([(k, "token = " + "0123456789abcdef"[k % 16] * 40 + " and more words here") for k in range(20)], "doc_id bigint, text string")
assert spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("hazeline") is None).first()
assert {{r.n_assign for r in secrets.scanned(docs).collect()}} == {{1}}
assert secrets.redacted(docs).filter("text LIKE '%[assign]%'").count() == 20
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
