"""Book files and stop lists.

Whole-file rows: ``path, file_name, file_size, content``.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright import fixed_values as fv
from tomewright.functions import header
from tomewright.functions.binding import bound
from tomewright.sources.artifacts import qualified
from tomewright.sources.listing import files_in_tasks, plain, uri


FILE_ROWS = "path string, file_name string, file_size bigint, content binary"


def _uri_row(path: str, size: int, content: bytes) -> list[tuple]:
    return [("file:" + uri(path), uri(path.rpartition("/")[2]), size, plain(path, content))]


def _path_row(path: str, size: int, content: bytes) -> list[tuple]:
    return [("file:" + path, uri(path.rpartition("/")[2]), size, content)]


def book_files(
    spark: SparkSession,
    path: str | list[str],
    recursive: bool = True,
    smaller_than: int | None = None,
) -> DataFrame:
    """One row per text file below ``path`` (a folder, file or glob).

    ``smaller_than`` is a strict size limit in bytes; it is a predicate on file
    metadata, so larger files are never opened.  Hidden files are not listed.
    More than ``listing.DRIVER_LISTS`` files on a mounted file system are listed and read by tasks.
    """
    found = files_in_tasks(spark, path, FILE_ROWS, _uri_row, recursive, smaller_than)
    if found is not None:
        return found.withColumn("content", F.col("content").cast("string"))
    reader = spark.read.option("recursiveFileLookup", recursive)
    files = reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("content"),
    )
    if smaller_than is not None:
        files = files.where(F.col("file_size") < smaller_than)
    return files


# Names of character sets that files declare, without spaces, hyphens and underscores.
CHARSETS = {
    "latin-1": ("ISO88591", "LATIN1", "ISOLATIN1", "L1"),
    "iso8859-2": ("ISO88592", "LATIN2", "ISOLATIN2", "L2"),
    "iso8859-15": ("ISO885915", "LATIN9", "ISOLATIN9", "L9"),
    "cp1252": ("WINDOWS1252", "CP1252", "CODEPAGE1252", "ANSI", "ISO88591WINDOWS1252"),
}


def _changed_letters(charset: str) -> tuple[str, str]:
    """Characters that a single-byte charset has in other places than ISO-8859-1, and what is there."""
    pairs = [(chr(b), bytes([b]).decode(charset, "replace")) for b in range(0x80, 0x100)]
    differ = [(a, c) for a, c in pairs if a != c and c != "\ufffd"]
    return "".join(a for a, _ in differ), "".join(c for _, c in differ)


def book_files_by_charset(
    spark: SparkSession, path: str | list[str], recursive: bool = True, smaller_than: int | None = None
) -> DataFrame:
    """Like ``book_files``, each file decoded by the charset that it declares.

    ISO-8859-1 maps every byte, so the header is readable before the charset is
    known.  Files without a known declaration are read as UTF-8.
    """
    found = files_in_tasks(spark, path, FILE_ROWS, _path_row, recursive, smaller_than)
    if found is not None:
        return found.withColumn("content", decoded(F.col("content")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    if smaller_than is not None:
        files = files.where(F.col("length") < smaller_than)
    return files.select(
        "path",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("length").alias("file_size"),
        decoded(F.col("content")).alias("content"),
    )


def decoded(content: Column) -> Column:
    """Bytes of a book file as text.

    ``CHARSETS`` lists the single-byte character sets that are known; any other
    declaration, or none, reads as UTF-8 with invalid bytes replaced.
    """

    def chosen(latin: Column) -> Column:
        said = header.field(latin, fv.CHARSET_NAME_LINE)
        name = F.upper(F.regexp_replace(F.regexp_replace(said, r"[\s_-]|\(.*\)|\bencoding\b", ""), r"[.,;].*$", ""))
        text = None
        for charset, names in CHARSETS.items():
            letters = _changed_letters(charset)
            own = F.translate(latin, *letters) if letters[0] else latin
            text = F.when(name.isin(*names), own) if text is None else text.when(name.isin(*names), own)
        return text.otherwise(F.make_valid_utf8(content.cast("string")))

    return bound(F.decode(content, "ISO-8859-1"), chosen)


def text_lines(content: Column) -> Column:
    """Array of lines; a final line end does not open another line."""
    return bound(
        F.split(content, fv.LINE_SEPARATOR),
        lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines),
    )


def lines_of(files: DataFrame) -> DataFrame:
    """``path, line_no, line`` with ``line_no`` from 0, one row per line."""
    numbered = files.select("path", F.posexplode_outer(text_lines(F.col("content"))).alias("line_no", "line"))
    return numbered.where(F.col("line_no").isNotNull())


def probe_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines on which ``pattern`` matches, with its first group as ``hit``."""
    return lines.withColumn("hit", header.field(F.col("line"), pattern)).where(F.col("hit").isNotNull())


def stop_words(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct ``word`` of a stop-list file, split at non-word characters."""
    return stop_words_of(spark.read.text(path).withColumnRenamed("value", "line"))


def stop_words_of(lines: DataFrame) -> DataFrame:
    words = lines.select(F.explode_outer(F.split("line", fv.ASCII_SEPARATOR)).alias("word"))
    return words.where(F.col("word").isNotNull()).distinct()


def count_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Number of files below ``path`` as ``n_files``; contents are not read."""
    files = files_in_tasks(spark, path, "file_size bigint", lambda path, size, content: [(size,)], reads=False)
    if files is not None:
        return files.agg(F.count("*").alias("n_files"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path").agg(F.count("*").alias("n_files"))


def count_files_by_folder(spark: SparkSession, folders: Sequence[str]) -> int:
    """Number of files below all ``folders``, which are listed one after the other, so that no listing of all of them is ever whole."""
    return sum(count_files(spark, folder).first()["n_files"] for folder in dict.fromkeys(folders))


def _folder_name(column: str, value: str | None) -> str:
    """The folder that Spark's writers give a value of a partition column."""
    escaped = re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value or "")
    return f"{column}={escaped or '__HIVE_DEFAULT_PARTITION__'}"


def write_each(rows: DataFrame, name: str, content: str, path: str) -> None:
    """Text files in folders by ``name``, which lie as ``partitionBy(name).text(path)`` lays them.

    On a mounted file system, Spark's writer starts a process for the rights of every file and
    renames all of them in the driver in the end, which takes far longer than the writing when nearly
    every row has its own folder.  There, tasks write the files where they belong; one that is tried
    again writes the same files.  Other file systems are left to Spark's writer.
    """
    full = qualified(rows.sparkSession, path)
    if not full.startswith("file:"):
        rows.select(name, content).write.partitionBy(name).text(path)
        return
    top, write = "/" + full.removeprefix("file:").lstrip("/"), uuid.uuid4()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, out, files = f"part-{TaskContext.get().partitionId():05d}-{write}.txt", None, None, 0
        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{top}/{_folder_name(name, value)}"
                if folder != last:
                    if out:
                        out.close()
                    os.makedirs(folder, exist_ok=True)
                    out, last, files = open(f"{folder}/{part}", "wb"), folder, files + 1
                out.write(text.as_py() or b"")
                out.write(b"\n")
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([files])], ["n"])

    os.makedirs(top)
    sorted_rows = rows.select(F.nullif(name, F.lit("")).alias(name), F.col(content).cast("binary")).sortWithinPartitions(name)
    sorted_rows.mapInArrow(written, "n long").agg(F.sum("n")).collect()
    open(f"{top}/_SUCCESS", "wb").close()
