"""Embedding whitening (operator 12): shifted CholeskyQR of the centred rows, and the SVD of the composed R."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Entries from this size on count as not finite, so that all sums of scaled entries are exact.
LARGEST = 2.0**36
#: Rounds of orthogonalisation at most; well-conditioned vectors need two or three.
ROUNDS = 6
ORTHOGONAL = 1e-12
_ROUNDING = 2.0**-53


def scaled(vector: Column) -> Column:
    """``floor(1024 c) + 100000`` of each entry, in whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and no entry null, infinite, not a number or beyond ``LARGEST``."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    return F.coalesce(fits, F.lit(False))


def fit_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``key, x`` of the vectors to fit, and their length.

    Vectors that are not ``usable`` are left out.  Should lengths differ, the most
    frequent one (of equally frequent ones the largest) is that of the vectors, and
    others are left out; so are empty vectors.
    """
    kept = rows.where(usable(rows[f"`{vector}`"])).select(rows[f"`{key}`"].alias("key"), scaled(rows[f"`{vector}`"]).alias("x"))
    sizes = kept.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).where("size > 0")
    found = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = found["size"] if found else 0
    return kept.where(F.size("x") == size if size else F.lit(False)), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def totals(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension; the driver gets ``size`` numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                x = _matrix(batch.column(0).slice(at, 10_000), size)
                n, total = n + len(x), [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * size, pa.int64())],
            ["place", "total", "n"],
        )

    parts = rows.select("x").mapInArrow(sums, "place int, total decimal(38,0), n long")
    found = {r["place"]: r for r in parts.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    return (found[0]["n"], [int(found[j]["total"]) for j in range(size)]) if found else (0, [])


@dataclass(frozen=True)
class Centre:
    """The mean ``whole + rest / n`` of each dimension, apart, so that a centred entry is rounded once."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n x - S)^2`` over the dimensions; null if beyond a long."""
        apart = x - self.whole
        most = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return (((apart * self.n - self.rest) ** 2).sum(axis=1)).tolist()
        exact = [sum((a * self.n - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in apart.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows @ inverse(upper)``, by substitution column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(rows: DataFrame, size: int, width: int, prepared) -> np.ndarray:
    """Sum over all rows of ``y' y`` for ``y = prepared(x)`` of ``width`` columns.

    Each task sends one ``width`` by ``width`` matrix, row by row; equal rows are
    summed by a task each, in the order of partitions, so that reruns agree.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = prepared(_matrix(batch.column(0), size))
            total += y.T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
            ["place", "part", "row"],
        )

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(r) for r in parts.sort_values("part")["row"]]
        return pd.DataFrame({"place": parts["place"].iloc[:1], "row": [np.sum(rows, axis=0).tobytes()]})

    found = rows.select("x").mapInArrow(products, "place int, part int, row binary")
    out = np.zeros((width, width))
    for r in found.groupBy("place").applyInPandas(summed, "place int, row binary").collect():
        out[r["place"]] = np.frombuffer(r["row"])
    return out


def factor(products: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor, with ``shift`` added to the diagonal if there is none without it."""
    try:
        return np.linalg.cholesky(products).T
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(products + shift * np.eye(len(products))).T


def orthogonal_triangle(rows: DataFrame, size: int, centre: Centre, rounds: int = ROUNDS) -> np.ndarray:
    """``R`` with ``X'X = R'R`` for the centred rows ``X``, without forming what squares its condition.

    Round by round the rows, solved by the factors so far, give a Gram matrix; its
    Cholesky factor is the next one.  The first is shifted, which keeps it positive
    for any vectors.  Rounds end when the solved rows are orthogonal.  Directions
    without variance never get there: what is left of them is put into the last factor.
    """
    factors: list[np.ndarray] = []

    def prepared(x: np.ndarray) -> np.ndarray:
        y = centre.centred(x)
        for upper in factors:
            y = solved(y, upper)
        return y

    def shift(products: np.ndarray) -> float:
        return 11 * (centre.n * size + size * (size + 1)) * _ROUNDING * float(np.trace(products)) or 1.0

    for k in range(rounds):
        products = gram(rows, size, size, prepared)
        if k and np.abs(products - np.eye(size)).max() <= ORTHOGONAL:
            break
        if k == rounds - 1:
            value, vector = np.linalg.eigh(products)
            factors.append(np.sqrt(np.maximum(value, 0))[:, None] * vector.T)
        elif k:
            factors.append(factor(products, shift(products)))
        else:
            factors.append(np.linalg.cholesky(products + shift(products) * np.eye(size)).T)
    triangle = np.eye(size)
    for upper in factors:
        triangle = upper @ triangle
    return triangle


@dataclass(frozen=True)
class Whitening:
    """Components by falling variance, those without any left out; ``explained`` is each one's share of the whole variance."""

    size: int
    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.variances)[:, None]).T


def fit(rows: DataFrame, size: int, most: int = COMPONENTS) -> Whitening | None:
    """Components of ``fit_rows``; None without vectors.

    What reaches the driver is bounded by the length of the vectors: sums, and one
    Gram matrix a round.  ``identity_error`` is measured on the whitened rows.
    """
    n, sums = totals(rows, size) if size else (0, [])
    if not n:
        return None
    centre = Centre.of(n, sums)
    _, singular, directions = np.linalg.svd(orthogonal_triangle(rows, size, centre))
    count = min(most, int((singular > singular[0] * size * 1e-14).sum()) if singular[0] > 0 else 0)
    components = directions[:count] * np.sign(directions[np.arange(count), np.abs(directions[:count]).argmax(axis=1)])[:, None]
    found = Whitening(
        size, centre, components, singular[:count] ** 2 / n, singular[:count] ** 2 / np.sum(singular**2) if count else np.empty(0)
    )
    if not count:
        return found

    def prepared(x: np.ndarray) -> np.ndarray:
        return np.column_stack([found.whitened(x), np.ones(len(x))])

    products = gram(rows, size, count + 1, prepared) / n
    mean = products[:-1, -1]
    error = np.abs(products[:-1, :-1] - np.outer(mean, mean) - np.eye(count)).max()
    return Whitening(size, centre, components, found.variances, found.explained, float(error))


def whiten(vectors: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """``key, deviation, whitened array<double>`` of every vector fitted, and the components.

    A vector that is null or holds a null, infinite or huge entry or no number is
    left out, as ``fit_rows`` says; what remains is fitted and returned row by row,
    rows that repeat and rows without key too.  ``deviation`` is the exact sum of
    ``(n x - S)^2``, null beyond a long.  Components without variance do not
    exist, so equal vectors, or a single one, give empty lists; no vectors give no
    rows.  Among equal variances the choice of components is free.  Other columns are
    not read.  Passes over the vectors: length, sums, one a round, and the error.
    """
    rows, size = fit_rows(vectors, key, vector)
    model = fit(rows, size, most)
    schema = rows.select("key", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")).schema

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(model.centre.deviations(x), pa.int64()), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))],
                ["key", "deviation", "whitened"],
            )

    out = rows.mapInArrow(sent, schema) if model else vectors.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = [float(e) for e in model.explained] if model else []
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.centre.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("place")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
