"""Splitting text into words and reducing words to terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright import fixed_values as fv
from tomewright.functions.binding import bound

TERMS_TYPE = "array<struct<term:string,n:bigint>>"


def unicode_words(text: Column) -> Column:
    """Array of words: runs of letters, numbers and ``_`` of any script."""
    return F.array_remove(F.split(text, fv.UNICODE_SEPARATOR), "")


def ascii_words(text: Column) -> Column:
    """Array of ASCII words; the empty strings at the ends of the split are kept."""
    return F.split(text, fv.ASCII_SEPARATOR)


def without_final_s(word: Column) -> Column:
    return F.when(F.endswith(word, F.lit("s")), F.left(word, F.length(word) - 1)).otherwise(word)


def singular(word: Column) -> Column:
    """Crude singular: lower case, minus one final ``s`` (``glass`` -> ``glas``)."""
    return without_final_s(F.lower(word))


def singulars(words: Column) -> Column:
    """``singular`` for an array of words."""
    return F.transform(words, singular)


def drop_listed(words: Column, stop_words: Sequence[str], ignore_case: bool = False) -> Column:
    """Remove listed words from an array (a hash-set probe for each word).

    ``ignore_case`` compares both sides in lower case.
    """
    if not stop_words:
        return words
    listed = sorted({word.lower() if ignore_case else word for word in stop_words})

    def kept(w: Column) -> Column:
        return ~(F.lower(w) if ignore_case else w).isin(listed)

    return F.filter(words, kept)


def runs(sorted_words: Column) -> Column:
    """Run lengths of a sorted array: ``array<struct<term, n>>`` ordered by term."""

    def count(words: Column) -> Column:
        # The k-th word from 0 ends a run if the next one differs; behind the last there is null.
        last = F.filter(words, lambda word, k: ~word.eqNullSafe(F.get(words, k + 1)))
        ends = F.filter(
            F.sequence(F.lit(1), F.size(words)), lambda i, k: ~F.get(words, k).eqNullSafe(F.get(words, i))
        )
        lengths = bound(
            ends,
            lambda e: F.transform(e, lambda end, k: (end - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("bigint")),
        )
        return F.arrays_zip(last.alias("term"), lengths.alias("n"))

    # sequence(1, 0) would count downwards, so an empty array has its own branch.
    return bound(
        sorted_words,
        lambda words: F.when(F.size(words) > 0, count(words)).otherwise(
            F.array().cast(TERMS_TYPE)
        ),
    )
