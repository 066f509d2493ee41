"""Bounded looks at a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """``n`` rows; with ``order`` the first ones, without any."""
    return (df.orderBy(*order) if order else df).limit(n)


def sample_with_replacement(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """Exactly ``n`` independent uniform draws (none from an empty dataset).

    Each draw takes the row with the least hash of seed, draw number and ``key``
    (columns that identify a row), so it is one pass with a partial aggregate and
    gives the same rows for any partitioning and after any retry.
    """
    ident = F.concat_ws("|", *[F.col(c).cast("string") for c in key])

    def ticket(draw: int) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}|{draw}|"), ident))

    row = F.struct(*df.columns)
    drawn = df.agg(*[F.min_by(row, F.struct(ticket(d), *key)).alias(f"draw_{d}") for d in range(n)])
    picks = F.array(*[F.struct(F.lit(d).alias("draw"), F.col(f"draw_{d}").alias("row")) for d in range(n)])
    return drawn.select(F.inline(picks)).where(F.col("row").isNotNull()).select("draw", "row.*")
