"""NFKC and the removal of accents, which Spark SQL lacks: the text steps that run in Python, in Arrow batches and in a projection of their own."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """NFKC of a text; texts without a character that it could change skip Python's normaliser."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return form(text)


@cache
def _marks() -> re.Pattern:
    at = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "M"]
    return re.compile("[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip([b for a, b in zip([-9, *at], at) if b != a + 1], [a for a, b in zip(at, [*at[1:], -9]) if b != a + 1], strict=True)) + "]+")


def plain(text: str) -> str:
    """Lower case character by character, then without accents and other marks, as DuckDB's strip_accents(lower(text))."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", _marks().sub("", unicodedata.normalize("NFD", text.replace("\u03a3", "\u03c3").lower())))


def plain_words(text: Column) -> Column:
    """The words of a text, of two letters, digits or underscores or more, in lower case and without accents, joined by blanks."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else " ".join(re.findall(r"\w\w+", plain(t))))

    return form(text)
