"""Spelling variant grouping (operator 11): asymmetric q-chunks, joined within shift one and verified."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.sources.artifacts import staged

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 5
MIN_COUNT = 3
TYPO_EVERY = 97
#: A word's form occurs at least so many times as often.
FORM_FACTOR = 2


def runs_of(text: Column) -> Column:
    """Maximal runs of letters, A-Z in lower case and no other letter changed."""
    found = F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))
    return F.transform(found, lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase))


def with_typo(doc_id: Column, run: Column) -> Column:
    """The run, or without one code point if ``TYPO_EVERY`` divides the crc32 of ``<doc_id>:<run>``."""
    ticket = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (ticket % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(ticket % TYPO_EVERY == 0, cut).otherwise(run)


def words_of(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the runs of all texts, some with a letter lost, that are long and frequent enough.

    Runs are counted per task before any is shuffled.
    """
    run = docs.select(docs["doc_id"].alias("doc_id"), F.explode(runs_of(docs["text"])).alias("run")).where(F.length("run") >= min_chars)
    word = run.select(with_typo(F.col("doc_id"), F.col("run")).alias("word"))
    counted = word.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


def _q(length: Column) -> Column:
    """Length of the two chunks of a word of ``length``; they never overlap."""
    return F.floor(length / 2).cast("int")


def chunks_of(words: DataFrame) -> DataFrame:
    """Two disjoint chunks of each word, its beginning and its end, with the word's length and the chunk's place."""
    size = F.length("word")
    place = F.explode(F.array(F.lit(0), size - _q(size))).alias("place")
    placed = words.select("word", "n", size.alias("size"), place)
    return placed.select("size", F.substring("word", F.col("place") + 1, _q(F.col("size"))).alias("gram"), "place", "word", "n")


def grams_of(words: DataFrame) -> DataFrame:
    """All positional grams of each word, as long as the chunks of words of its length or longer by one.

    Grams further than one place from either chunk of such a word cannot meet any and go before the shuffle.
    """
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    places = F.sequence(F.lit(0), F.length("word") - _q(F.col("size")))
    placed = sized.select("size", F.explode(places).alias("at"), "word", "n")
    placed = placed.where((F.col("at") <= 1) | (F.col("at") >= F.col("size") - _q(F.col("size")) - 1))
    return placed.select("size", F.substring("word", F.col("at") + 1, _q(F.col("size"))).alias("gram"), "at", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """``long, n_long, short, n_short``: each pair of words one edit apart once, of equally long ones the first as ``long``.

    The longer word contributes two disjoint chunks, the other all its positional
    grams.  One edit spoils at most one chunk; the other is found where it was, or
    one place before if a letter in front of it is gone.  So chunks meet grams of
    equal text at places at most one apart: the place is part of the join's key, and
    no word meets all words that share a common syllable.  What meets is verified by
    edit distance.  A pair that keeps both chunks is taken by the first one.
    """
    left, right = chunks_of(words), grams_of(words)
    shifted = left.select(
        "size", "gram", "place", F.col("word").alias("long"), F.col("n").alias("n_long"),
        F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("at"),
    )
    met = shifted.join(right.select("size", "gram", "at", F.col("word").alias("short"), F.col("n").alias("n_short")), ["size", "gram", "at"])
    once = (F.length("short") < F.col("size")) | (F.col("long") < F.col("short"))
    # A kept chunk is at the same distance from the end of both words, or from the beginning; any other place is chance.
    anchored = F.col("at") == F.when(F.col("place") == 0, 0).otherwise(F.length("short") - _q(F.col("size")))
    first = (F.col("place") == 0) | ~F.startswith("short", F.substring("long", F.lit(1), _q(F.col("size"))))
    near = F.levenshtein("long", "short", 1) == 1
    return met.where(once & anchored & first & near).select("long", "n_long", "short", "n_short")


def forms(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n`` of each word that has a near one.

    The form is the near word of largest count, of equal ones the smallest, if it
    occurs at least ``factor`` times as often; a word's near words are reduced by task first.
    """
    pairs = near_pairs(words)
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("long").alias("word"), F.col("n_long").alias("n"), F.col("short").alias("near"), F.col("n_short").alias("near_n")),
                F.struct(F.col("short").alias("word"), F.col("n_short").alias("n"), F.col("long").alias("near"), F.col("n_long").alias("near_n")),
            )
        )
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    counts = -F.col("best.less") >= factor * F.col("n")
    return found.select(
        "word", "n", "n_near", F.when(counts, F.col("best.near")).alias("form"), F.when(counts, -F.col("best.less")).alias("form_n")
    )


def roots(formed: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """``word, root`` of each word with a form: where following forms ends.

    Every step multiplies the count by ``factor`` or more, so chains are short; each
    round follows twice as many steps, and the largest count says how many rounds do.
    """
    links = staged(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), "n", "form_n"), "spelling_links")
    ends = links.agg(F.max("form_n").alias("most"), F.min("n").alias("least")).first()
    steps = math.log(ends["most"] / ends["least"], factor) + 1 if ends["most"] else 1
    found = links.select("word", "root")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = staged(found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling_roots")
    return found


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """Words with their more frequent spelling: ``word, form, root, n, n_near, form_n``, one row per word.

    Words are the runs of letters of all texts, A-Z in lower case; a run loses a
    letter where ``with_typo`` says so.  Two words are near if one inserted, deleted
    or replaced code point makes them equal.  ``form`` is the most frequent near word,
    if that is ``factor`` times as frequent as the word; ``root`` the end of the chain of forms.

    A null text has no words; a null ``doc_id`` is an empty one in the typo's ticket.
    Repeated rows count each.  A run of any length is one word.  No rows give no
    rows.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    words = staged(words_of(docs, min_chars, min_count), "spelling_words")
    formed = staged(forms(words, factor), "spelling_forms")
    rows = words.join(formed.drop("n"), "word", "left").join(roots(formed, factor), "word", "left")
    return rows.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
