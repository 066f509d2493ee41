"""From folders of files to stored results.

Only file listings and single numbers pass through the driver.  A text is read
and split once; what moves between executors afterwards are counts, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright import fixed_values as fv
from tomewright.functions.header import BookFormat, HeaderRules
from tomewright.operators import extract
from tomewright.operators.postings import merged_postings, posting_lists
from tomewright.operators.profiles import merged, profiles, term_counts
from tomewright.operators.vectors import hash_cells, load_vectors, vector_rows
from tomewright.sources import files as src
from tomewright.sources.artifacts import qualified, read_or_build, staged
from tomewright.sources.metadata import metadata_files

StopWords = Sequence[str] | DataFrame | None


def _stored_by_folder(spark: SparkSession, folders: Sequence[str], out: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in some folders, as one Parquet dataset at ``out``.

    Every folder is listed and stored on its own, so the driver never holds the
    listing of a whole collection of small files, and a second call goes on with
    the folders that are not complete.  A part is named by a hash of its folder's
    full path, and the result has exactly the folders asked for, each once.
    Nested folders are refused.
    """
    paths = [qualified(spark, folder) for folder in folders]
    for one in paths:
        for other in paths:
            if one != other and one.startswith(other.rstrip("/") + "/"):
                raise ValueError(f"{one} lies in {other}: its files would be stored twice")
    parts = {path: f"{out.rstrip('/')}/folder_{hashlib.sha256(path.encode()).hexdigest()[:32]}" for path in paths}
    for path, part in parts.items():
        read_or_build(spark, part, lambda path=path: read(path))
    return spark.read.parquet(*parts.values())


def stored_books(spark: SparkSession, folders: Sequence[str], out: str) -> DataFrame:
    """Book files of some folders as one Parquet dataset at ``out``, for repeated use; texts are decoded by their declared charset."""
    return _stored_by_folder(spark, folders, out, lambda path: src.book_files_by_charset(spark, path))


def stored_metadata(spark: SparkSession, folders: Sequence[str], out: str) -> DataFrame:
    """Metadata records of the RDF files of some folders as one Parquet dataset at ``out``."""
    return _stored_by_folder(spark, folders, out, lambda path: metadata_files(spark, path))


def book_profiles(
    files: DataFrame,
    book_format: BookFormat,
    rules: HeaderRules | None = None,
    stop_words: StopWords = None,
    transliterate: bool = False,
) -> DataFrame:
    """Profiles of the best edition of each book: ``doc_id, max_n, terms``.

    Editions are weeded out after counting: counting is row-local, and profiles
    are a fraction of the texts, so the texts are read once and never moved.
    """
    docs = extract.documents(files, book_format, rules)
    return _one_edition(docs, extract.best_edition, ["doc_id", "enc_rank"], stop_words, transliterate)


def line_book_profiles(
    files: DataFrame,
    book_format: BookFormat,
    rules: HeaderRules | None = None,
    stop_words: StopWords = None,
    transliterate: bool = False,
    cut_footer: bool = False,
) -> DataFrame:
    """Profiles by line-wise extraction, of the first edition of each book."""
    docs = extract.line_documents(files, book_format, rules, cut_footer)
    return _one_edition(docs, extract.first_edition, ["doc_id"], stop_words, transliterate)


def _one_edition(docs, choose, carry, stop_words, transliterate) -> DataFrame:
    editions = profiles(
        docs, "path", "body", carry=carry, stop_words=stop_words, transliterate=transliterate, drop_empty=False
    )
    chosen = choose(staged(editions, "editions")).where(F.col("max_n").isNotNull())
    return staged(chosen.select("doc_id", "max_n", "terms"), "profiles")


def book_vectors(
    spark: SparkSession,
    text: str | DataFrame,
    out: str,
    book_format: BookFormat,
    stop_path: str | None = None,
    rules: HeaderRules | None = None,
    smaller_than: int | None = None,
    transliterate: bool = False,
    n_docs: int | None = None,
    size: int | Sequence[int] = fv.VECTOR_SIZE,
    by_line: bool = False,
) -> DataFrame:
    """Hashed TF.IDF vectors of all books, stored at ``out``.

    ``text`` is a folder or the rows of ``stored_books``.  A finished result at
    ``out`` is loaded instead.  ``smaller_than`` leaves out files of that many
    bytes or more and changes nothing else; ``by_line`` selects line-wise extraction.
    Files are decoded by the charset that each declares.
    """

    def build() -> DataFrame:
        found = src.book_files_by_charset(spark, text) if isinstance(text, str) else text
        if smaller_than is not None:
            found = found.where(F.col("file_size") < smaller_than)
        stop = src.stop_words(spark, stop_path) if stop_path else None
        profile = (line_book_profiles if by_line else book_profiles)(found, book_format, rules, stop, transliterate)
        total = size if isinstance(size, int) else sum(size)
        return vector_rows(hash_cells(profile, size, n_docs=n_docs, by_document=True), total)

    read_or_build(spark, out, build)
    return load_vectors(spark, out)


def book_metadata(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Metadata records of all RDF files below ``path``, stored at ``out``."""
    return read_or_build(spark, out, lambda: metadata_files(spark, path))


def file_index(files: DataFrame, block: int, stop_words: StopWords = None) -> DataFrame:
    """Inverted index over file names, from ASCII words without headers removed.

    Files of one name in several folders count as one; ``block`` is that of ``posting_lists``.
    """
    counted = profiles(
        files, "path", "content", carry=["file_name"], ascii_only=True, stop_words=stop_words, stop_raw=False
    )
    counted = staged(counted.select("file_name", "terms"), "profiles")
    # Only names that several files share are summed by a shuffle; the counts of the others are ready in their row.
    shared = counted.groupBy("file_name").count().where(F.col("count") > 1).select(F.col("file_name").alias("shared_name"))
    shared = staged(shared, "shared_names")
    same = F.col("file_name").eqNullSafe(F.col("shared_name"))
    several = staged(merged(counted.join(shared, same, "left_semi"), "file_name"), "counts")
    by_name = term_counts(counted.join(shared, same, "left_anti"), "file_name").unionByName(several)
    return posting_lists(merged_postings(by_name, "file_name"), block, "file_name")
