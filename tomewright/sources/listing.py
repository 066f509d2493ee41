"""Files of folders that hold very many, listed and read by tasks.

Spark's readers list in the driver, which then holds every file's status and a task for each few files.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import os
import re
import stat
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tomewright.sources.artifacts import qualified

#: Entries of folders that the driver lists at most; of more, only their beginning.
DRIVER_LISTS = 10_000
#: Rows and bytes that a task hands on at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000

#: Names of files that only Hadoop's codecs decompress.
OTHER_CODECS = (".zst", ".snappy", ".lz4")

Root = tuple[bytes, str | None]


def _hidden(name: bytes, folder: bool = False) -> bool:
    """As Spark's readers leave files and folders out."""
    if name.startswith(b"_") and b"=" not in name:
        return not (folder and name.startswith((b"_metadata", b"_common_metadata")))
    return name.startswith(b".") or name.endswith(b"._COPYING_")


def _roots(spark: SparkSession, path: str | list[str], recursive: bool) -> list[Root] | None:
    """Folders, and patterns of names in them; none if a path is something else, which is left to Spark's readers.

    That is: another file system, a single file, a pattern of folders' names, a folder that is not read
    recursively (its names may be partitions), or nothing.
    """
    found = []
    for one in [path] if isinstance(path, str) else path:
        full = qualified(spark, one)
        folder, _, last = ("/" + full.removeprefix("file:").lstrip("/")).rpartition("/")
        if not full.startswith("file:") or re.search(r"[*?\[\]{}\\]", folder) or re.search(r"[\[\]{}\\]", last):
            return None
        if re.search(r"[*?]", last):
            found.append((os.fsencode(folder or "/"), last))
        elif recursive:
            found.append((os.fsencode(f"{folder}/{last}"), None))
        else:
            return None
        if not os.path.isdir(found[-1][0]):
            return None
    return found


def _first(root: Root) -> Iterator[tuple[bytes, bool] | None]:
    """Path of each entry of a root, and whether it is a folder; none for what is left out."""
    folder, pattern = root
    with os.scandir(folder) as entries:
        for entry in entries:
            is_folder = entry.is_dir()
            if pattern is None:
                yield None if _hidden(entry.name, is_folder) else (entry.path, is_folder)
            else:
                # A folder that the caller's pattern names is read, hidden or not.
                said = fnmatch.fnmatchcase(os.fsdecode(entry.name), pattern)
                yield (entry.path, is_folder) if said and (is_folder or not _hidden(entry.name)) else None


def _inside(folder: bytes, recursive: bool) -> Iterator[tuple[bytes, bool]]:
    """Entries of a folder below a root."""
    for entry in _first((folder, None)):
        if entry and (recursive or not entry[1]):
            yield entry
        elif entry and b"=" in os.path.basename(entry[0]):
            raise ValueError(f"{os.fsdecode(entry[0])} is named like a partition: read its folder recursively")


def _walk(folder: bytes, recursive: bool) -> Iterator[bytes]:
    """Files of a folder."""
    todo = [folder]
    while todo:
        for path, is_folder in _inside(todo.pop(), recursive):
            if is_folder:
                todo.append(path)
            else:
                yield path


def _many(roots: Iterable[Root], recursive: bool) -> bool:
    """Whether the driver would list more than ``DRIVER_LISTS`` entries; it stops there."""

    def seen() -> Iterator[None]:
        folders = []
        for root in roots:
            for entry in _first(root):
                yield None
                if entry and entry[1]:
                    folders.append(entry[0])
        while folders:
            for entry in _first((folders.pop(), None)):
                yield None
                if entry and entry[1] and recursive:
                    folders.append(entry[0])

    return next(islice(seen(), DRIVER_LISTS, None), 0) is None


def uri(path: str) -> str:
    """A path as Spark's file metadata spell it."""

    def quoted(found: re.Match) -> str:
        c = found[0]
        if ord(c) > 127 and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc"):
            return c
        return "".join(f"%{b:02X}" for b in c.encode())

    return re.sub(r"""[^A-Za-z0-9_\-!.~'()*,;:$&+=@/]""", quoted, path)


def plain(path: str, content: bytes) -> bytes:
    """Content of a file, decompressed as the end of its name says."""
    end = os.path.splitext(path)[1]
    if end in OTHER_CODECS:
        raise ValueError(f"{path}: files compressed like this are read in folders of at most {DRIVER_LISTS} files only")
    return {".gz": gzip.decompress, ".bz2": bz2.decompress, ".deflate": zlib.decompress}.get(end, bytes)(content)


#: What rows a file gives: of its path, its size and its content.
Rows = Callable[[str, int, bytes], Iterable[tuple]]


def files_in_tasks(
    spark: SparkSession, path: str | list[str], schema: str, rows: Rows, recursive: bool = True,
    smaller_than: int | None = None, reads: bool = True,
) -> DataFrame | None:
    """``rows`` of each file below ``path``; none where Spark's readers can list, or have to.

    They can list up to ``DRIVER_LISTS`` entries; they have to where tasks cannot list, on file systems that are
    not mounted.  Tasks list the roots, then, dealt anew, what these hold, then, dealt anew again, the
    rest, and read each file where it comes out: only paths move, and no process holds more than a batch of
    them.  Without ``reads`` no file is opened.
    """
    roots = _roots(spark, path, recursive)
    if not roots or not _many(roots, recursive):
        return None
    entries = "path binary, folder boolean"
    names, kinds = zip(*(part.split() for part in schema.split(", ")), strict=True)
    types = [{"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}[kind] for kind in kinds]

    def batches_of(found: Iterable[tuple], names, types) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for row in found:
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bool]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    def listed(found: Iterable[tuple[bytes, bool]]) -> Iterator[pa.RecordBatch]:
        return batches_of(found, ["path", "folder"], [pa.binary(), pa.bool_()])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, _ in entries_of(batches):
            yield from listed(entry for entry in _first(roots[int(place)]) if entry)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from listed(chain.from_iterable(_inside(p, recursive) if folder else [(p, folder)] for p, folder in entries_of(batches)))

    def of_file(path: bytes) -> Iterable[tuple]:
        try:
            status = os.stat(path)
        except FileNotFoundError:  # a link to nothing
            return []
        if not stat.S_ISREG(status.st_mode) or not status.st_size or (smaller_than is not None and status.st_size >= smaller_than):
            return []
        content = b""
        if reads:
            with open(path, "rb") as file:
                content = file.read()
        return rows(path.decode("utf-8", "replace"), status.st_size, content)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = chain.from_iterable(_walk(p, recursive) if folder else [p] for p, folder in entries_of(batches))
        yield from batches_of(chain.from_iterable(map(of_file, paths)), names, types)

    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tops = spark.createDataFrame([(str(i).encode(), True) for i in range(len(roots))], entries).repartition(len(roots))
    found = tops.mapInArrow(first, entries).repartition(parts, "path").mapInArrow(second, entries).repartition(parts, "path")
    return found.mapInArrow(last, schema)
