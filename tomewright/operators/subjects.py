"""Subjects of books: frequency and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright import fixed_values as fv


def book_subjects(metadata: DataFrame) -> DataFrame:
    """Distinct ``ebook_id, subject`` pairs."""
    pairs = metadata.select("ebook_id", F.explode("subjects.subject_txt").alias("subject"))
    return pairs.where(F.col("subject").isNotNull() & F.col("ebook_id").isNotNull()).distinct()


def top_subjects(metadata: DataFrame, k: int = fv.TOP_SUBJECTS) -> DataFrame:
    """The ``k`` subjects with most books: ``subject, n_books``, ties by subject."""
    counted = book_subjects(metadata).groupBy("subject").agg(F.count("*").alias("n_books"))
    return counted.orderBy(F.desc("n_books"), "subject").limit(k)


def subject_labels(docs: DataFrame, metadata: DataFrame, k: int = fv.TOP_SUBJECTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``subject, label``: one row per document and top subject.

    The label says whether the book has the subject.  The ``k`` subjects enter as
    one array value, so a document row turns into its labels where it is, and only
    they are gathered for each book.  Books without metadata have none of them.
    """
    top = top_subjects(metadata, k).agg(F.sort_array(F.collect_list("subject"))).scalar()
    listed = book_subjects(metadata).where(F.array_contains(top, F.col("subject")))
    own = listed.groupBy("ebook_id").agg(F.collect_list("subject").alias("own"))
    joined = docs.join(own.withColumnRenamed("ebook_id", key), key, "left")
    return joined.select(*docs.columns, "own", F.explode_outer(top).alias("subject")).select(
        *docs.columns, "subject",
        F.coalesce(F.array_contains("own", F.col("subject")).cast("int"), F.lit(0)).alias("label"),
    )
