"""Term counts.

The central dataset is the *profile*: one row per document with its term counts
nested, ``max_n bigint, terms array<struct<term, n>>`` (terms in order).  All
words of a document come out of one input row, so counting them needs no
shuffle at all: split, sort and run lengths happen inside the row.  The maximum
frequency is known at the same place, and so are normalised frequencies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import words as w
from tomewright.functions.binding import rows_of
from tomewright.functions.latin import to_ascii
from tomewright.sources.artifacts import staged

# A list given as a table is probed inside each row, like a sequence, up to this many words and bytes; a longer one is joined.
PROBED_WORDS = 500
PROBED_BYTES = 16 << 10


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", ascii_only: bool = False) -> DataFrame:
    """Tidy tokens ``key, raw, term``, one row per word occurrence."""
    split = (w.ascii_words if ascii_only else w.unicode_words)(F.col(text))
    raw = docs.select(key, F.explode_outer(split).alias("raw")).where(F.col("raw").isNotNull())
    return raw.withColumn("term", w.singular(F.col("raw")))


def profiles(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    carry: Sequence[str] = (),
    ascii_only: bool = False,
    stop_words: Sequence[str] | DataFrame | None = None,
    stop_raw: bool = True,
    ignore_case: bool = False,
    min_term_len: int = 0,
    transliterate: bool = False,
    drop_empty: bool = True,
) -> DataFrame:
    """Profile of each row of ``docs``: ``key, carry..., max_n, terms``.

    Each row has its own profile, whether or not another has its ``key``;
    ``merged`` combines rows of one key.  Rows without a surviving term are
    dropped unless ``drop_empty`` is off; then their ``max_n`` is null.
    ``ascii_only`` splits at everything but ASCII word characters and keeps empty
    words.  A word is dropped if its term is listed, and with ``stop_raw`` also if
    the word itself is listed; ``ignore_case`` compares words and list in lower case.

    ``stop_words`` is a sequence for a list that fits a plan (some hundred words),
    probed inside each row, or a DataFrame with the column ``word`` for a list of
    any length.  That is written and measured: a short one is probed inside each row
    too, so its rows do not move, and a longer one is joined.  All give the same rows.
    """
    source = to_ascii(F.col(text)) if transliterate else F.col(text)
    raw = (w.ascii_words if ascii_only else w.unicode_words)(source)
    if isinstance(stop_words, DataFrame):
        word = F.lower("word") if ignore_case else F.col("word")
        stop_words = staged(stop_words.select(word.alias("word")).distinct(), "stop_words")
        short = _short_list(stop_words)
        stop_words = stop_words if short is None else short
    if isinstance(stop_words, DataFrame):
        return _with_joined_list(
            docs, [key, *carry], w.runs(F.sort_array(raw)), stop_words, stop_raw, ignore_case, min_term_len, drop_empty
        )
    listed = list(stop_words or ())
    if stop_raw:
        raw = w.drop_listed(raw, listed, ignore_case)
    terms = w.drop_listed(w.singulars(raw), listed, ignore_case)
    if min_term_len:
        terms = F.filter(terms, lambda t: F.length(t) >= min_term_len)
    return _with_max(docs, [key, *carry], w.runs(F.sort_array(terms)), drop_empty)


def _with_max(rows: DataFrame, keep: Sequence[str], terms: Column, drop_empty: bool = True) -> DataFrame:
    profile = F.transform(
        F.array(terms),
        lambda t: F.struct(
            F.array_max(t["n"]).alias("max_n"),
            t.alias("terms"),
        ),
    )
    # array_max of nothing is null, which drops documents without terms.
    return rows_of(rows, profile, *keep, required="max_n" if drop_empty else "terms")


def _short_list(stop: DataFrame) -> list[str] | None:
    """The words of a written list that fits a plan, else none."""
    size = stop.agg(F.count("word").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).first()
    if size.words > PROBED_WORDS or (size.bytes or 0) > PROBED_BYTES:
        return None
    return [row.word for row in stop.where(F.col("word").isNotNull()).collect()]


def _with_joined_list(
    docs: DataFrame, keep: list[str], raw_terms: Column, stop: DataFrame,
    stop_raw: bool, ignore_case: bool, min_term_len: int, drop_empty: bool,
) -> DataFrame:
    """Profiles after a stop list of any length, a written table.

    Words are counted inside the row first, so a frequent word reaches the join
    once per row.  Those counts are written with a number for each row, which the
    regrouping uses.  Spark knows the size of the list: a small one is broadcast,
    a long one joined by a shuffle that adaptive execution can split where words
    are skewed.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    raw = staged(_with_max(numbered, ["_row", *keep], raw_terms, drop_empty=False).drop("max_n"), "raw_counts")
    rows = raw.select("_row", F.inline("terms")).withColumnRenamed("term", "raw")
    if stop_raw:
        probe = F.lower("raw") if ignore_case else F.col("raw")
        rows = rows.withColumn("probe", probe).join(stop.withColumnRenamed("word", "probe"), "probe", "left_anti")
    rows = rows.withColumn("term", w.singular(F.col("raw")))
    rows = rows.join(stop.withColumnRenamed("word", "term"), "term", "left_anti")
    if min_term_len:
        rows = rows.where(F.length("term") >= min_term_len)
    counts = rows.groupBy("_row", "term").agg(F.sum("n").alias("n"))
    found = raw.select("_row", *keep).join(nested(counts, "_row"), "_row", "inner" if drop_empty else "left")
    return found.select(*keep, "max_n", F.coalesce("terms", F.array().cast(w.TERMS_TYPE)).alias("terms"))


def term_counts(profile: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tidy counts ``key, term, n``."""
    return profile.select(key, F.inline_outer("terms"))


def nested(counts: DataFrame, key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Tidy counts back to profiles.  A group is no larger than its document was."""
    return counts.groupBy(key, *carry).agg(
        F.max("n").alias("max_n"), F.sort_array(F.collect_list(F.struct("term", "n"))).alias("terms")
    )


def merged(profile: DataFrame, key: str) -> DataFrame:
    """Tidy counts ``key, term, n`` for a key that several rows may share.

    The profiles have already combined each row, so this sums few rows per key
    and term, and sums them partially before the shuffle.
    """
    return term_counts(profile, key).groupBy(key, "term").agg(F.sum("n").alias("n"))


def max_counts(profile: DataFrame, key: str = "doc_id") -> DataFrame:
    """Highest term frequency of each document."""
    return profile.select(key, "max_n")


def top_term(profile: DataFrame, key: str = "doc_id") -> DataFrame:
    """Most frequent term of each document, ties to the smallest term."""
    first = F.filter("terms", lambda t: t["n"] == F.col("max_n"))[0]
    return profile.select(key, first["term"].alias("term"), F.col("max_n").alias("n"))


def max_merged(counts: DataFrame, key: str) -> DataFrame:
    """``max_counts`` and ``top_term`` at once, for tidy counts: ``key, term, n``."""
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("term")))
    return counts.groupBy(key).agg(best.alias("best")).select(
        key, F.col("best.term").alias("term"), (-F.col("best.minus_n")).alias("n")
    )
