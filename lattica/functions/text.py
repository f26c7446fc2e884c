"""Trigrams, codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[^\p{L}\p{N}]+"


def trigrams(text: Column, separators: str = WORDS) -> Column:
    """The different trigrams of the lower-cased words, each with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), separators), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; null if neither text has any."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def code_parts(code: Column, pattern: str, names: list[str]) -> list[Column]:
    return [F.regexp_extract(code, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def composed(*parts: Column) -> Column:
    """Parts of a name in one string; missing ones leave no gap."""
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def equal_but_for_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
