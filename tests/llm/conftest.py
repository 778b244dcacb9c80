import pytest
from pyspark.sql import functions as F

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int) -> str:
    """n words that look random, the same for each seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % 20] + str((x >> 8) % 97))
    return " ".join(out)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, size string, __key_other map<string,int>"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and extra columns with names that operators use."""
    rows = [
        (1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (3, prose(1, 79) + " changed", "en", None), (4, prose(2, 120), "de", "b"),
        (4, prose(3, 60), None, "b"), (None, prose(4, 70), "en", "b"), (None, prose(4, 70), "en", "b"), (5, None, "en", "a"), (6, "", "en", "a"), (7, " \t\n ", None, None),
        (8, "one", "fr", "c"), (9, "one", "fr", "c"), (10, prose(5, 60_000), "en", "c"), (11, "é" * 10 + " ünï " + "\U0001f600" * 3, "es", "é"), (None, None, None, None),
        (12, prose(6, 70) + "\n" + prose(6, 70), "en", "b"), (13, "x" * 3_000_000, "en", "d"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "s", {"k": 1}) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter(F.lit(False))
