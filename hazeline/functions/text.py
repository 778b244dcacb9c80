"""Text normalization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline.contracts import NULL_TOKEN

# Every character that counts as whitespace.
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove whitespace of every kind at both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(_WHITESPACE))


def null_token(text: Column) -> Column:
    """Stripped text; empty text and N/A in any case become null."""
    stripped = strip(text)
    return F.when((stripped != "") & (F.upper(stripped) != NULL_TOKEN), stripped)


def _trim_underscores(text: Column) -> Column:
    return F.regexp_replace(text, "^_+|_+$", "")


def setting_key(name: Column) -> Column:
    """Upper-case key where every run of characters outside A-Z and 0-9 is one underscore."""
    return _trim_underscores(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "_"))


def city_key(name: Column) -> Column:
    """Upper-case key where each character that is no letter or digit of any script is an underscore."""
    return _trim_underscores(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]", "_"))


def first_text(*choices: Column) -> Column:
    """First non-null, non-empty text."""
    return F.coalesce(*[F.when(c != "", c) for c in choices])
