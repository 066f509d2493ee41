"""Portable feature hashing of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_hash(term: Column) -> Column:
    """First 32 bits of MD5 as a non-negative bigint; the same in every engine."""
    return F.conv(F.left(F.md5(term.cast("binary")), F.lit(8)), 16, 10).cast("bigint")


def place(hashed: Column, size: int) -> Column:
    """Bucket in ``[0, size)`` of a ``term_hash``; bucket 0 if there is no size."""
    return (hashed % size).cast("int") if size else F.lit(0)


def bucket(term: Column, size: int) -> Column:
    """Bucket in ``[0, size)``; bucket 0 if there is no size."""
    return place(term_hash(term), size)


def sign(term: Column) -> Column:
    """+1 for terms of odd length, -1 for even."""
    return F.when(F.length(term) % 2 == 1, 1).otherwise(-1)
