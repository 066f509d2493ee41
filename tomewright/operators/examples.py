"""Rows to learn from: sparse features, labels of several subjects, part and fold; and their numbers inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sparse or dense MLlib vector as it is stored.
VECTOR = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
#: Cells that a task works on at a time; a row counts as so many at least.
CHUNK_CELLS, ROW_CELLS = 150_000, 50
#: Entries of a dense matrix for each filled cell at most; above that, cells are worked on one by one.
MOST_ZEROS = 60


def _is_sparse() -> Column:
    return F.col("features.type") == 0


def length_of(rows: DataFrame) -> int:
    """Length of the vectors."""
    size = F.when(_is_sparse(), F.col("features.size")).otherwise(F.size("features.values"))
    return rows.agg(F.max(size)).first()[0] or 0


def filled(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns, indices, values`` of each row's filled cells."""
    places = F.when(_is_sparse(), F.col("features.indices")).otherwise(F.sequence(F.lit(0), F.size("features.values") - 1))
    return rows.select(*columns, places.alias("indices"), F.col("features.values").alias("values"))


def cells(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns, bucket, value``: one row for each filled cell."""
    zipped = F.arrays_zip(F.col("indices").alias("bucket"), F.col("values").alias("value"))
    kept = filled(rows, *columns)
    return kept.select(*[c for c in kept.columns if c not in ("indices", "values")], F.inline(zipped))


@dataclass
class Block:
    """Some rows in a task: cells in the order of rows, and where each row's begin."""

    labels: np.ndarray
    testing: np.ndarray
    fold: np.ndarray
    begin: np.ndarray
    bucket: np.ndarray
    value: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.begin) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.begin))

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Buckets that occur and the rows as a matrix of them; none where that would hold almost only zeros."""
        if not len(self.bucket):
            return None
        occurs = np.zeros(self.bucket.max() + 1, bool)
        occurs[self.bucket] = True
        used = np.flatnonzero(occurs)
        if self.rows * len(used) > MOST_ZEROS * len(self.bucket):
            return None
        number = np.cumsum(occurs) - 1
        out = np.zeros((self.rows, len(used)))
        out[self.owner, number[self.bucket]] = self.value
        return used, out

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Product of the rows with a matrix of one line a bucket."""
        if self.dense is not None:
            used, own = self.dense
            return own @ weights[used]
        padded = np.vstack([weights[self.bucket] * self.value[:, None], np.zeros((1, weights.shape[1]))])
        out = np.add.reduceat(padded, self.begin[:-1]) if self.rows else padded[:0]
        out[np.diff(self.begin) == 0] = 0
        return out

    def turned(self, of_rows: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` the product of the transposed rows with a matrix of one line a row."""
        if self.dense is not None:
            used, own = self.dense
            out[used] += own.T @ of_rows
        elif len(self.bucket):
            order = np.argsort(self.bucket, kind="stable")
            bucket = self.bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            out[bucket[first]] += np.add.reduceat(of_rows[self.owner[order]] * self.value[order, None], first)


def blocks(batch: pa.RecordBatch, most: int = CHUNK_CELLS):
    """Blocks of some ``most`` cells of a batch of ``labels, testing, fold, indices, values``, with the first row of each."""
    lengths = batch.column("indices").value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, ROW_CELLS))
    cut = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(lengths)] if len(lengths) else []
    for a, b in zip(cut, cut[1:]):
        part = batch.slice(a, b - a)
        labels = part.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
        yield a, Block(
            labels, part.column("testing").to_numpy(zero_copy_only=False), part.column("fold").to_numpy(zero_copy_only=False),
            np.concatenate([[0], np.cumsum(lengths[a:b])]), part.column("indices").flatten().to_numpy(zero_copy_only=False),
            part.column("values").flatten().to_numpy(zero_copy_only=False),
        )


def sliced(matrix: np.ndarray, width: int = 256) -> pa.RecordBatch:
    """A task's matrix in rows of ``width`` lines, to be summed by ``gathered``."""
    parts = [matrix[i : i + width].tobytes() for i in range(0, len(matrix), width)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])


SLICES = "slice int, part binary"


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(p) for p in parts["part"]], axis=0)
    return pd.DataFrame({"slice": parts["slice"].iloc[:1], "part": [total.tobytes()]})


def gathered(parts: DataFrame, shape: tuple[int, int], width: int = 256) -> np.ndarray:
    """Sum of ``sliced`` matrices of all tasks; slices are summed by tasks, and only the sum reaches the driver."""
    out = np.zeros(shape)
    for row in parts.groupBy("slice").applyInPandas(_summed, SLICES).collect():
        at = row["slice"] * width
        out[at : at + width] = np.frombuffer(row["part"]).reshape(-1, shape[1])
    return out


@dataclass(frozen=True)
class Setting:
    """What a model of several learns: a subject, without a fold (-1: with all), under a value of the method's setting."""

    subject: int
    without: int
    value: float


def settings(k: int, folds: Sequence[int], values: Sequence[float]) -> list[Setting]:
    """All models of a method: whole ones and, if there is a choice of values, one without each fold."""
    return [Setting(s, w, float(v)) for w in (-1, *(folds if len(values) > 1 else ())) for s in range(k) for v in values]


def judged(rows: DataFrame, key: str, models: Sequence[Setting], judge: Callable[[Block], np.ndarray]) -> DataFrame:
    """``key, place, value, fold, testing, label, prediction`` of all models in one pass.

    ``judge`` gives a block's predictions, one column a model.  A whole model judges
    every row and has a null ``fold``; one without a fold judges that fold's training rows.
    """
    kept = filled(rows, F.col(key), "labels", "testing", "fold")
    empty = {"place": "int", "value": "double", "fold": "int", "testing": "boolean", "label": "double", "prediction": "double"}
    schema = rows.select(F.col(key), *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()]).schema
    subject, without = np.array([m.subject for m in models], np.int32), np.array([m.without for m in models], np.int32)
    value = np.array([m.value for m in models])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch):
                asked = (without < 0) | (~block.testing[:, None] & (block.fold[:, None] == without))
                row, model = np.nonzero(asked)
                columns = [
                    batch.column(0).take(pa.array(first + row)), pa.array(subject[model]), pa.array(value[model]),
                    pa.array(without[model], mask=without[model] < 0), pa.array(block.testing[row]),
                    pa.array(block.labels[row, subject[model]]), pa.array(judge(block)[row, model].astype(np.float64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(found, schema)
