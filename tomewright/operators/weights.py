"""Document frequencies, normalised term frequencies and their product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright import fixed_values as fv
from tomewright.sources.artifacts import staged

# A vocabulary estimated to need no more memory than this is broadcast whole.
BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 120
# In a larger one, terms that hold at least this share of all rows are called hot.
# There cannot be more than 1 / HOT_SHARE of them; the most frequent of them that
# together take at most HOT_BYTES are broadcast.
HOT_SHARE = 1 / 500_000
HOT_BYTES = 64 << 20


def document_count(profile: DataFrame) -> DataFrame:
    """Number of documents with at least one term, as ``n_docs``."""
    return profile.agg(F.count("*").alias("n_docs"))


def document_frequency(profile: DataFrame) -> DataFrame:
    """Number of documents for each term: ``term, df``."""
    return profile.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(profile: DataFrame, n_docs: int | None = None) -> DataFrame:
    """``term, df, idf`` with ``idf = log2(N / df)``.

    N is the number of profiles unless ``n_docs`` overrides it.
    """
    total = F.lit(n_docs) if n_docs is not None else document_count(profile).scalar()
    return document_frequency(profile).select(
        "term", "df", F.log2(total.cast("double") / F.col("df")).alias("idf")
    )


def normalised(n: Column, max_n: Column, smoothing: float = fv.TF_SMOOTHING) -> Column:
    return F.lit(smoothing) + F.lit(1 - smoothing) * n / max_n


def term_frequency(profile: DataFrame, key: str = "doc_id", smoothing: float = fv.TF_SMOOTHING) -> DataFrame:
    """``key, term, n, tf`` with ``tf`` between ``smoothing`` and 1; no shuffle."""
    return profile.select(key, "max_n", F.inline_outer("terms")).select(
        key, "term", "n", normalised(F.col("n"), F.col("max_n"), smoothing).alias("tf")
    )


def with_vocabulary(
    rows: DataFrame, words: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, keep: Sequence[str] | None = None
) -> DataFrame:
    """Inner join of ``rows`` with ``words(term, df, ...)`` on ``term``.

    ``words`` is a written table in which ``df`` is the number of rows of a term.
    Its size is measured first, and a small one is broadcast.  Otherwise only the
    hot terms are, which hold most rows of a text collection: those rows do not
    move.  The rest is joined by shuffle, where no term is left that could
    overload a task.  ``rows`` is evaluated once: hot terms are looked up first,
    and the rows are written with what was found.  ``keep`` names the columns that
    are asked for, all by default; of the others, only what the join needs is written.
    """
    keep = list(keep or [*rows.columns, *[c for c in words.columns if c != "term"]])
    size = words.agg(
        F.count("*").alias("words"), F.sum(F.octet_length("term")).alias("bytes"), F.sum("df").alias("rows")
    ).first()
    if (size.bytes or 0) + size.words * ROW_OVERHEAD <= broadcast_bytes:
        return rows.join(F.broadcast(words), "term").select(*keep)
    # At most 1 / HOT_SHARE rows are put in order here.
    above = words.where(F.col("df") >= size.rows * HOT_SHARE)
    so_far = F.sum(F.octet_length("term") + ROW_OVERHEAD).over(Window.orderBy(F.desc("df"), "term"))
    hot = staged(above.withColumn("so_far", so_far).where(F.col("so_far") <= HOT_BYTES).drop("so_far"), "hot_terms")
    more = [c for c in words.columns if c != "term" and c in keep]
    told = hot.select("term", F.struct(F.lit(True).alias("found"), *more).alias("_word"))
    term = F.col("term") if "term" in keep else F.when(F.col("_word").isNull(), F.col("term")).alias("term")
    looked_up = rows.join(F.broadcast(told), "term", "left")
    marked = staged(looked_up.select(term, *[c for c in rows.columns if c in keep and c != "term"], "_word"), "marked")
    found = marked.where(F.col("_word").isNotNull()).select("*", "_word.*")
    rest = marked.where(F.col("_word").isNull()).drop("_word")
    others = words.select("term", *more).join(F.broadcast(hot.select("term")), "term", "left_anti")
    return found.select(*keep).unionByName(rest.join(others, "term").select(*keep))


def tfidf(
    profile: DataFrame,
    key: str = "doc_id",
    smoothing: float = fv.TF_SMOOTHING,
    n_docs: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``key, term, tf, idf, tfidf``.  ``profile`` should be a staged table."""
    words = staged(vocabulary(profile, n_docs), "vocabulary")
    weighed = with_vocabulary(term_frequency(profile, key, smoothing), words, broadcast_bytes)
    return weighed.select(key, "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def top_terms(weighed: DataFrame, k: int, key: str = "doc_id", weight: str = "tfidf") -> DataFrame:
    """The ``k`` heaviest terms of each document with their ``rank``, ties by term.

    Spark cuts each partition to ``k`` rows per document before it shuffles.
    """
    order = Window.partitionBy(key).orderBy(F.desc(weight), "term")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
