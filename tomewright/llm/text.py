"""Small helpers of the operators in this package: columns, bytes and hashes inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
# Bytes of UTF-8 text: A-Z to lower case, other ASCII than letters and digits to a space.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def payload(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, nulls as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def plain_words(data: bytes) -> list[bytes]:
    """Words of letters and digits, A-Z in lower case; any code point from U+0080 on counts as a letter."""
    return data.translate(PLAIN).split()


def count_words(data: bytes) -> int:
    """Number of runs of anything but ASCII white space, without building them."""
    white = IS_WHITE[np.frombuffer(data, np.uint8)]
    return int(len(white) > 0 and not white[0]) + int(np.count_nonzero(white[:-1] & ~white[1:]))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (wraps silently)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive 64-bit values."""
    count = max(0, len(values) - size + 1)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + values[j : j + count]
    return mixed(total)


def chunks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``most``; a larger item is a range of its own."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes):
        if total and total + size > most:
            yield start, end
            start, total = end, 0
        total += size + 1
    if total:
        yield start, end + 1


def whole_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """The row as one struct ``doc`` next to derived columns, so that no name can clash."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    return docs.select(row, *[column.alias(name) for name, column in columns.items()])


def unwrapped(rows: DataFrame) -> DataFrame:
    """The documents again, with their own columns."""
    return rows.select("doc.*")


SLICES = "slice int, counts binary, n_docs long"


def count_slices(count: np.ndarray, n_docs: int, width: int = 1024) -> pa.RecordBatch:
    """A task's counts in rows of ``width`` numbers, to be summed by ``gathered``."""
    slices = [count[i : i + width].astype(np.int64).tobytes() for i in range(0, len(count), width)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(slices)), pa.int32()), pa.array(slices, pa.binary()), pa.array([n_docs] * len(slices), pa.int64())],
        ["slice", "counts", "n_docs"],
    )


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(c, np.int64) for c in rows["counts"]], axis=0)
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [total.tobytes()], "n_docs": [rows["n_docs"].sum()]})


def gathered(parts: DataFrame, size: int, width: int = 1024) -> tuple[np.ndarray, int]:
    """Sums of ``count_slices`` over all tasks: ``size`` numbers, however many rows were counted."""
    count, n_docs = np.zeros(size, np.int64), 0
    for row in parts.groupBy("slice").applyInPandas(_summed, SLICES).collect():
        count[row["slice"] * width :][:width] = np.frombuffer(row["counts"], np.int64)
        n_docs = row["n_docs"]
    return count, n_docs
