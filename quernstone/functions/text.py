"""Normalisation, tokens and stems.

Spark has no Unicode normalisation: texts with other than ASCII letters take that one step in an Arrow UDF, to which
the rest goes as null. Folding, cleaning, splitting and stemming are built-in expressions. Null texts count as empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.config import LONG_SUFFIXES, SHORT_SUFFIXES, STOP_WORDS
from quernstone.functions.batches import by_portions


@cache
def _decomposed(form: str):
    """One function object a form, so that equal plans are equal and exchanges can be reused."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_portions(lambda texts: [None if t is None else unicodedata.normalize(form, t) for t in texts], pa.string())(batches)

    return F.arrow_udf(run, "string")


def _folded(text: Column, form: str, marks: str) -> Column:
    """Lower case, decomposed, without the characters of ``marks``. ASCII texts, which are as many bytes as characters, stay as they are."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    other = F.when(F.octet_length(low) != F.length(low), low)
    return F.coalesce(F.regexp_replace(_decomposed(form)(other), marks, ""), low)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def normalize(text: Column) -> Column:
    """Lower case, marks dropped (NFKD), all but letters, digits and hyphens to single spaces."""
    return F.trim(F.regexp_replace(_folded(text, "NFKD", r"\p{M}+"), r"[^\p{L}\p{N}-]+", " "))


def normalize_routing(text: Column) -> Column:
    """As ``normalize``, and hyphens are spaces too."""
    return F.trim(F.regexp_replace(_folded(text, "NFKD", r"\p{M}+"), r"[^\p{L}\p{N}]+", " "))


def normalize_intent(text: Column) -> Column:
    """NFD, only U+0300 to U+036F dropped; other marks become spaces. Not to be mixed with ``normalize``."""
    return F.trim(F.regexp_replace(_folded(text, "NFD", r"[\u0300-\u036f]+"), r"[^\p{L}\p{N}]+", " "))


def _without(token: Column, endings: list[str], then) -> Column:
    """``then`` of the token without the first of ``endings`` it has; comparing ends is much cheaper than a pattern."""
    cut = [(e, then(F.left(token, F.length(token) - len(e)))) for e in sorted(endings, key=len, reverse=True)]
    return reduce(lambda c, x: c.when(token.endswith(x[0]), x[1]), cut[1:], F.when(token.endswith(cut[0][0]), cut[0][1])).otherwise(then(token))


def stem(token: Column) -> Column:
    """One long and one short ending off words of five or more ASCII letters; what remains may be short or empty."""
    short = lambda t: _without(t, SHORT_SUFFIXES, lambda x: x)
    return F.when((F.length(token) > 4) & token.rlike("^[a-z]+$"), _without(token, LONG_SUFFIXES, short)).otherwise(token)


def indexed(word: Column) -> Column:
    """Whether a word is in the index: longer than two and no stop word."""
    return (F.length(word) > 2) & ~word.isin(STOP_WORDS)


def tokens_of(normalized: Column) -> Column:
    """Index tokens of a normalised text: indexed words, stemmed; empty stems stay."""
    return F.transform(F.filter(F.split(normalized, " "), indexed), stem)


def tokens(text: Column) -> Column:
    return tokens_of(normalize(text))


def query_tokens(text: Column) -> Column:
    """Runs of three or more letters, digits and hyphens, without marks; neither stopped nor stemmed."""
    return F.regexp_extract_all(_folded(text, "NFKD", r"\p{M}+"), F.lit(r"[\p{L}\p{N}-]{3,}"), 0)


def text_tokens(normalized: Column) -> Column:
    """Words of more than one character of an intent-normalised text."""
    return F.filter(F.split(normalized, " "), lambda w: F.length(w) > 1)


def clean_text(text: Column) -> Column:
    """Runs of blanks to one, blanks after line ends dropped, at most one blank line, trimmed."""
    t = F.regexp_replace(text, "\\u00a0", " ")
    for pattern, by in (("[ \\t]+", " "), ("\\n[ \\t]+", "\n"), ("\\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def placeholders(text: Column) -> Column:
    """Sorted names in double braces."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\{\{\s*([A-Za-z0-9_.]+)\s*\}\}"), 1))
