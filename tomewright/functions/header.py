"""Fields of a book file: markers, id, character set, language, rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright import fixed_values as fv
from tomewright.functions.binding import bound

LINE_STARTS = "(?md)"


@dataclass(frozen=True)
class BookFormat:
    """Markers of a collection's files; they name its ``publisher``, as spelled in the files."""

    publisher: str

    def _marker(self, sides: tuple[str, str]) -> str:
        return rf"{sides[0]}\Q{self.publisher}\E{sides[1]}"

    @property
    def start(self) -> str:
        return self._marker(fv.START_MARKER)

    @property
    def end(self) -> str:
        return self._marker(fv.END_MARKER)


def language_line(language: str) -> str:
    return fv.LANGUAGE_LINE + language


def field(text: Column, pattern: str) -> Column:
    """First group of the first match, or null.  ``^`` stands for a line start."""
    return F.nullif(F.regexp_extract(text, LINE_STARTS + pattern, 1), F.lit(""))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(LINE_STARTS + pattern)


def marker_split(content: Column, pattern: str, limit: int = -1) -> Column:
    """Text around the markers: two parts mean exactly one marker."""
    return F.split(content, LINE_STARTS + pattern, limit)


def without_footer(body: Column, book_format: BookFormat) -> Column:
    """Text before the end marker if there is exactly one, else all of it."""
    return bound(
        marker_split(body, book_format.end),
        lambda parts: F.when(F.size(parts) == 2, parts[0]).otherwise(body),
    )


def book_id(text: Column) -> Column:
    """First book id with its ``#``, e.g. ``#42``."""
    return field(text, fv.BOOK_ID)


def canonical_id(book: Column) -> Column:
    """``#42`` -> ``42``, the form that metadata uses."""
    return F.ltrim(book, F.lit("#"))


def charset(header: Column) -> Column:
    return field(header, fv.CHARSET_LINE)


def charset_rank(declared: Column) -> Column:
    name = F.upper(declared)
    return (
        F.when(name == "UTF", fv.RANK_UTF).when(name == "ASCII", fv.RANK_ASCII).otherwise(fv.RANK_OTHER)
    )


def language_is(header: Column, language: str) -> Column:
    """Whether the header declares ``language`` (its line starts with that name)."""
    return has(header, language_line(language))


@dataclass(frozen=True)
class HeaderRules:
    """Patterns that drop a book, and patterns of which a kept book has at least one."""

    exclude: Sequence[str] = ()
    include: Sequence[str] = ()

    def keeps(self, header: Column) -> Column:
        def any_of(patterns: Sequence[str], none: bool) -> Column:
            return reduce(or_, [has(header, p) for p in patterns], F.lit(False)) if patterns else F.lit(none)

        return ~any_of(self.exclude, False) & any_of(self.include, True)


DEFAULT_RULES = HeaderRules(exclude=(fv.GENOME_LINE,), include=(fv.ASCII_LINE, language_line("English")))
