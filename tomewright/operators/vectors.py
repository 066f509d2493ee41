"""Signed feature hashing of weighed documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tomewright import fixed_values as fv
from tomewright.functions import hashing
from tomewright.operators.weights import BROADCAST_BYTES, term_frequency, vocabulary, with_vocabulary
from tomewright.sources.artifacts import stage, staged


def hash_cells(
    profile: DataFrame,
    parts: int | Sequence[int] = fv.VECTOR_SIZE,
    key: str = "doc_id",
    smoothing: float = fv.TF_SMOOTHING,
    n_docs: int | None = None,
    by_document: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``key, bucket, value``: absolute value of the signed TF.IDF sum of each bucket.

    With several ``parts`` the vector consists of parts of those sizes, and each
    term falls into one bucket of each part (double hashing).  Bucket and sign
    depend on the term only, so they are computed once per vocabulary entry, not
    once per document and term.  ``profile`` should be a staged table.

    The cells of one part are summed partially before the shuffle.  With ``by_document``
    the terms are shuffled by ``key`` instead, which the later grouping of cells to
    vectors reuses: one shuffle less, and no more in one task than the terms of
    a document, which came out of one row.  With several parts they always are, and fall
    into the buckets of the parts after it, so that a term moves once for all parts.
    """
    sizes = [parts] if isinstance(parts, int) else list(parts)
    one = hashing.bucket(F.col("term"), sizes[0]) if len(sizes) == 1 else hashing.term_hash(F.col("term"))
    words = vocabulary(profile, n_docs).select(
        "term", "df", (hashing.sign(F.col("term")) * F.col("idf")).alias("signed_idf"), one.alias("place")
    )
    frequencies = term_frequency(profile, key, smoothing).drop("n")
    rows = with_vocabulary(frequencies, staged(words, "hashed_vocabulary"), broadcast_bytes, [key, "tf", "signed_idf", "place"])
    cells = rows.select(key, "place", (F.col("tf") * F.col("signed_idf")).alias("value"))
    if by_document or len(sizes) > 1:
        cells = cells.repartition(key)
    if len(sizes) == 1:
        cells = cells.withColumnRenamed("place", "bucket")
    else:
        places = [hashing.place(F.col("place"), size) + sum(sizes[:i]) for i, size in enumerate(sizes)]
        cells = cells.select(key, F.explode(F.array(*places)).alias("bucket"), "value")
    return cells.groupBy(key, "bucket").agg(F.abs(F.sum("value")).alias("value"))


def double_hash_sizes(size: int = fv.VECTOR_SIZE) -> tuple[int, int]:
    """Two parts of similar, different and coprime size that make up ``size``."""
    half = size // 2
    return (half - 1, size - half + 1) if size % 2 == 0 else (half, half + 1)


def vector_rows(cells: DataFrame, size: int = fv.VECTOR_SIZE, key: str = "doc_id") -> DataFrame:
    """``key, features`` in the storage layout of a sparse MLlib vector.

    A group has at most ``size`` cells.  Zero cells are left out of the vector,
    but only after the grouping: a document of zeros keeps its row.
    """
    grouped = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", "value"))).alias("cells"))
    filled = F.filter("cells", lambda c: c["value"] != 0)
    return grouped.select(key, filled.alias("cells")).select(
        key,
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(size).alias("size"),
            F.col("cells.bucket").alias("indices"),
            F.col("cells.value").alias("values"),
        ).alias("features"),
    )


def load_vectors(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Stored ``vector_rows`` as ``key, features`` with MLlib vectors."""
    key_field = spark.read.parquet(path).schema[key]
    schema = StructType([key_field, StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def feature_vectors(cells: DataFrame, size: int = fv.VECTOR_SIZE, key: str = "doc_id") -> DataFrame:
    """``key, features`` with one sparse MLlib vector per document.

    The rows are written in the layout of the vector type and read back as that
    type, which keeps the conversion inside the JVM; training iterates over the
    written table.
    """
    return load_vectors(cells.sparkSession, stage(vector_rows(cells, size, key), "vectors"), key)
