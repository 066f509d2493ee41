"""Inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions.hashing import term_hash
from tomewright.operators.profiles import term_counts
from tomewright.operators.weights import document_frequency, with_vocabulary
from tomewright.sources.artifacts import staged


def postings(profile: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tidy index ``term, df, key, n``: one row per term and document."""
    return _indexed(term_counts(profile, key), document_frequency(profile), key)


def merged_postings(counts: DataFrame, key: str) -> DataFrame:
    """``postings`` from tidy counts ``key, term, n``, which should be a staged table.

    For keys that several rows share: their terms are never gathered in one row.
    """
    return _indexed(counts, counts.groupBy("term").agg(F.count("*").alias("df")), key)


def _indexed(counts: DataFrame, frequency: DataFrame, key: str) -> DataFrame:
    words = staged(frequency, "document_frequency")
    return with_vocabulary(counts, words).select("term", "df", key, "n")


def posting_lists(index: DataFrame, block: int, key: str = "doc_id") -> DataFrame:
    """Nested index ``term, df, block, blocks, postings array<struct<key, n>>``.

    A row holds about ``block`` postings: a term in up to ``block`` documents has
    one row, a more frequent one is spread over ``blocks`` rows by a hash of the
    document, so no task or row has to hold the documents of a word that is in all
    of them; nothing is left out.  10,000 is a good value.
    """
    blocks = F.ceil(F.col("df") / block).cast("int")
    spread = index.select(
        "term", "df", F.struct(key, "n").alias("posting"), blocks.alias("blocks"),
        F.pmod(term_hash(F.col(key).cast("string")), blocks).cast("int").alias("block"),
    )
    lists = spread.groupBy("term", "df", "blocks", "block").agg(
        F.sort_array(F.collect_list("posting")).alias("postings")
    )
    return lists.select("term", "df", "block", "blocks", "postings")
