"""Text normalisers and similarities as column functions.

Each family of the ledger domain has its own normaliser; they are not interchangeable, so they are
named apart. All are null-safe as stated.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(c: Column) -> Column:
    """Case folding for text whose other letters are dropped later: lower case, and ss for the sharp s."""
    return F.replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("ß"), F.lit("ss"))


def plain(c: Column) -> Column:
    """ASCII letters and digits in lower case, all else one space; null is ''."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def match_text(c: Column) -> Column:
    """Like plain, but [bracketed] parts are dropped first."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"\[[^\]]+\]", " "), "[^a-z0-9]+", " "))


def header_key(c: Column) -> Column:
    """Like plain with _ between words; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(""))


def code_key(c: Column) -> Column:
    """Letters and digits run together; null where nothing is left."""
    return F.nullif(F.regexp_replace(fold(c), "[^a-z0-9]+", ""), F.lit(""))


def words(c: Column, least: int = 1) -> Column:
    """Distinct words of plain text with at least so many characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(plain(c), " "), lambda w: F.length(w) >= least)))


def jaccard(a: Column, b: Column, empty: Column | None = None) -> Column:
    """Shared share of two arrays of distinct values; where one is empty, the value given or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), empty if empty is not None else F.lit(None).cast("double")).otherwise(both / (F.size(a) + F.size(b) - both))


def ratio(left: str, right: str) -> float:
    """Ratcliff-Obershelp ratio of two normalised texts; 0 if one is empty. Not symmetric."""
    if not left or not right:
        return 0.0
    return 1.0 if left == right else SequenceMatcher(None, left, right).ratio()


def ratios(lefts: list[str], rights: list[str], least: float) -> list[list[float]]:
    """Ratios of all pairs, lefts by rights; what their lengths show to be under least is 0."""
    out = [[0.0] * len(rights) for _ in lefts]
    for j, right in enumerate(rights):
        matcher = SequenceMatcher()
        matcher.set_seq2(right)
        for i, left in enumerate(lefts):
            if left and right:
                matcher.set_seq1(left)
                if left == right:
                    out[i][j] = 1.0
                elif matcher.real_quick_ratio() >= least:
                    out[i][j] = matcher.ratio()
    return out


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of pairs of texts that are normalised already."""
    return pd.Series([ratio(a or "", b or "") for a, b in zip(left, right, strict=True)], dtype="float64")


def text_score(left: Column, right: Column) -> Column:
    """1 if equal, .9 of the length share if one holds the other, else the ratio; of normalised texts."""
    small, big = F.least(F.length(left), F.length(right)), F.greatest(F.length(left), F.length(right))
    held = F.contains(left, right) | F.contains(right, left)
    return F.when((left == "") | (right == ""), 0.0).when(left == right, 1.0).when(held, 0.9 * small / big).otherwise(similarity(left, right))


@F.pandas_udf(T.StringType())
def compatible_header(c: pd.Series) -> pd.Series:
    """NFKC and case folding, ASCII words joined by a space."""
    return c.map(lambda x: " ".join(re.findall(r"[a-z0-9]+", unicodedata.normalize("NFKC", x or "").casefold())))


@F.pandas_udf(T.ArrayType(T.StringType()))
def header_tokens(c: pd.Series) -> pd.Series:
    """NFKC, folded, words of any script, sorted and distinct."""
    return c.map(lambda x: sorted(set(re.findall(r"\w+", unicodedata.normalize("NFKC", x or "").casefold()))))
