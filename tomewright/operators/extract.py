"""From book files to documents: header, body, id, character-set rank.

Everything here is row-local: no operator but ``one_per_key`` shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright import fixed_values as fv
from tomewright.functions import header as h
from tomewright.functions.binding import bound, rows_of
from tomewright.functions.latin import to_ascii
from tomewright.sources.artifacts import staged
from tomewright.sources.files import text_lines


def split_header(files: DataFrame, book_format: h.BookFormat) -> DataFrame:
    """Adds ``header`` and ``body`` in place of ``content``.

    A file stays only if it has exactly one start marker.
    """
    parts = F.array(h.marker_split(F.col("content"), book_format.start))
    halves = F.transform(
        F.filter(parts, lambda p: F.size(p) == 2),
        lambda p: F.struct(p[0].alias("header"), p[1].alias("body")),
    )
    return rows_of(files, halves, *[c for c in files.columns if c != "content"], required="header")


def documents(files: DataFrame, book_format: h.BookFormat, rules: h.HeaderRules | None = None) -> DataFrame:
    """Documents of whole book files: ``path, doc_id, enc_rank, body``.

    Drops files without exactly one start marker, without text after it, without
    a book id in the header, or rejected by the header ``rules``.  Bodies that
    declare a character set other than UTF or ASCII are transliterated.
    """
    books = split_header(files, book_format).where(F.col("body") != "")
    if rules:
        books = books.where(rules.keeps(F.col("header")))
    declared = h.charset(F.col("header"))
    rank = h.charset_rank(declared)
    foreign = declared.isNotNull() & (rank == fv.RANK_OTHER)
    return with_id_only(
        books.select(
            "path",
            h.canonical_id(h.book_id(F.col("header"))).alias("doc_id"),
            rank.alias("enc_rank"),
            bound(
                h.without_footer(F.col("body"), book_format), lambda body: F.when(foreign, to_ascii(body)).otherwise(body)
            ).alias("body"),
        )
    )


def with_id_only(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull())


def documents_unfiltered(files: DataFrame, book_format: h.BookFormat, english_only: bool = False) -> DataFrame:
    """Id anywhere in the file, and everything after the first start marker.

    ``doc_id`` and ``body`` are null where they are not found; with
    ``english_only`` both are null unless some line declares English.
    """
    content = F.col("content")
    body = bound(h.marker_split(content, book_format.start, 2), lambda p: F.when(F.size(p) == 2, p[1]))
    doc_id = h.canonical_id(h.book_id(content))
    if english_only:
        english = h.language_is(content, "English")
        doc_id, body = F.when(english, doc_id), F.when(english, body)
    return files.select("path", doc_id.alias("doc_id"), body.alias("body"))


def line_documents(
    files: DataFrame, book_format: h.BookFormat, rules: h.HeaderRules | None = None, cut_footer: bool = False
) -> DataFrame:
    """Documents by lines: ``path, doc_id, body``, body lines joined by a space.

    The header ends with the first line that holds a start marker, the body is
    all lines after it; rules see the header, the id may be on any line.  The
    lines of a file never leave its row, so there is nothing to shuffle and the
    number of jobs does not depend on the number of files.
    """

    def marked(lines: Column, pattern: str) -> Column:
        return F.transform(lines, lambda line: line.rlike(pattern))

    def body_of(lines: Column) -> Column:
        if not cut_footer:
            return lines
        return bound(
            marked(lines, book_format.end),
            lambda ends: F.when(
                F.size(F.filter(ends, lambda e: e)) == 1,
                F.slice(lines, 1, F.array_position(ends, True).cast("int") - 1),
            ).otherwise(lines),
        )

    def halves(lines: Column) -> Column:
        return bound(
            F.array_position(marked(lines, book_format.start), True).cast("int"),
            lambda at: F.struct(
                at.alias("at"),
                F.array_join(F.slice(lines, 1, at), "\n").alias("header"),
                F.slice(lines, at + 1, F.size(lines)).alias("rest"),
            ),
        )

    split = F.filter(
        F.transform(F.array(text_lines(F.col("content"))), halves),
        lambda s: (s["at"] > 0) & (F.size(s["rest"]) > 0),
    )
    joined = F.transform(
        split,
        lambda s: F.struct(
            s["header"].alias("header"), F.array_join(body_of(s["rest"]), " ").alias("body")
        ),
    )
    books = rows_of(
        files, joined, "path", h.canonical_id(h.book_id(F.col("content"))).alias("doc_id"), required="header"
    )
    if rules:
        books = books.where(rules.keeps(F.col("header")))
    return with_id_only(books.select("path", "doc_id", "body"))


def one_per_key(rows: DataFrame, key: str, *preference: Column, row_id: str = "path") -> DataFrame:
    """Keep one row for each ``key``: the least by ``preference``, then by ``row_id``.

    Winners are found on narrow columns: a group is reduced before the shuffle
    however many copies it has.  ``row_id`` names a row, as a path does a file: of
    rows that repeat one, as overlapping folders give them, one is kept too.  The
    narrow columns are written once and read by both steps, so ``rows`` is
    evaluated twice: for them, and for the result.  Losers are written with their
    real size, which lets Spark broadcast them while they are few (no wide row
    moves), or sort-merge if they are not.
    """
    tickets = staged(rows.select(key, F.struct(*preference, F.col(row_id).alias("row_id")).alias("place")), "places")
    winners = tickets.groupBy(key).agg(F.min("place").alias("place")).select(F.col("place.row_id").alias(row_id))
    losers = tickets.select(F.col("place.row_id").alias(row_id)).join(winners, row_id, "left_anti")
    kept = rows.join(staged(losers.distinct(), "losers"), row_id, "left_anti")
    most = tickets.groupBy("place.row_id").count().agg(F.max("count")).first()[0] or 0
    return kept.dropDuplicates([row_id]) if most > 1 else kept


def best_edition(rows: DataFrame, key: str = "doc_id", row_id: str = "path") -> DataFrame:
    """One edition for each book: the best character set, then the smallest path."""
    return one_per_key(rows, key, (-F.col("enc_rank")).alias("rank"), row_id=row_id)


def first_edition(rows: DataFrame, key: str = "doc_id", row_id: str = "path") -> DataFrame:
    """One edition for each book: the smallest path."""
    return one_per_key(rows, key, row_id=row_id)
