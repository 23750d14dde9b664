"""Names: trimming, normal forms, tokens, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Weights of the blended score and bounds of the confidence buckets.
SEQUENCE_WEIGHT, SORTED_WEIGHT, OVERLAP_WEIGHT = 0.55, 0.35, 0.10
HIGH, MEDIUM = 0.92, 0.86


def trimmed(name: Column) -> Column:
    """The name without white space around it, empty for null."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")


def team_key(name: Column) -> Column:
    """Lower case, white space collapsed, punctuation gone but for & and -."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(name)), r"\s+", " "), r"(?U)[^\w\s&-]", "")


@F.pandas_udf(StringType())
def without_accents(names: pd.Series) -> pd.Series:
    """Compatibility forms without combining marks, case-folded."""
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return names.map(lambda s: None if s is None else fold(s))


def loose_key(name: Column) -> Column:
    """without_accents() with everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(without_accents(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " "))


def sorted_tokens(name: Column) -> Column:
    """The words in order."""
    return F.array_join(F.array_sort(F.filter(F.split(name, r"\s+"), lambda t: t != "")), " ")


def overlap(a: Column, b: Column) -> Column:
    """Common distinct words as a share of the larger set; 0 if either is empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    larger = F.greatest(F.size(words(a)), F.size(words(b)))
    empty = (F.size(words(a)) == 0) | (F.size(words(b)) == 0)
    return F.when(empty, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(words(a), words(b))).cast("double"), larger.cast("double")))


@F.pandas_udf(DoubleType())
def matched_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching blocks of two strings (longest common blocks first)."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """The blended score of two loose keys, 0 if one is empty."""
    blend = SEQUENCE_WEIGHT * matched_share(a, b) + SORTED_WEIGHT * matched_share(sorted_tokens(a), sorted_tokens(b)) + OVERLAP_WEIGHT * overlap(a, b)
    return F.when((a == "") | (b == ""), 0.0).otherwise(blend)


def confidence(score: Column) -> Column:
    """HIGH, MED or LOW."""
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MED").otherwise("LOW")


def sql_quoted(value: Column) -> Column:
    """A string as an SQL literal."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
