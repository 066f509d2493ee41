"""Evaluate a costly expression once.

Catalyst merges neighbouring projections by inlining expressions, and pushes
filters below projections by copying them.  For a regex split over a whole book
that means doing the split several times.  Two idioms keep it at one:

* ``bound`` hands a value to a lambda, whose variable is computed once per row;
* ``rows_of`` puts the value behind a generator, whose output columns are plain
  attributes that no later rule expands again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def rows_of(df: DataFrame, structs: Column, *keep: str | Column, required: str) -> DataFrame:
    """One row per element of ``structs``, next to the ``keep`` columns.

    ``required`` names a field that is never null in a real element; it tells
    the rows of ``inline_outer`` for empty arrays from real ones.  The outer
    form is used because the inner form makes Catalyst infer a filter that
    evaluates ``structs`` a second time.
    """
    return df.select(*keep, F.inline_outer(structs)).where(F.col(required).isNotNull())
