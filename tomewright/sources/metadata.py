"""RDF/XML book metadata.

Rows: ``file_name, ebook_id, subjects, birth_year`` with ``subjects`` an
``array<struct<subject_id, subject_txt>>`` in document order.  A file with two
e-books gives two rows.
"""

from __future__ import annotations

import re
from itertools import islice
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomewright import fixed_values as fv
from tomewright.functions.binding import bound, rows_of
from tomewright.sources import listing
from tomewright.sources.artifacts import staged
from tomewright.sources.listing import files_in_tasks

EBOOK_TAG = "pgterms:ebook"
EBOOK_FIELDS = """
    `_rdf:about`: string,
    `dcterms:creator`: array<struct<`pgterms:agent`: struct<`pgterms:birthdate`: string>>>,
    `dcterms:subject`: array<struct<`rdf:Description`:
        array<struct<`_rdf:nodeID`: string, `rdf:value`: string>>>>
"""


def metadata_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Metadata records of all RDF files below ``path``.

    More than ``listing.DRIVER_LISTS`` files on a mounted file system are listed and read by tasks, which cut
    well-formed ones into their e-books; the records are written.  Spark's reader has the others, some at a time.
    """
    found = files_in_tasks(spark, path, "path string, file_name string, xml string", _ebook_rows)
    if found is None:
        return _read(spark, path)
    book = F.from_xml(F.col("xml"), f"struct<{EBOOK_FIELDS}>").alias("book")
    parsed = found.select("path", "file_name", F.col("xml").isNull().alias("left"), book).select("path", "file_name", "left", "book.*")
    parsed = staged(parsed.select("path", "left", "file_name", *_record()), "records")
    result, left = parsed.where("not left").drop("path", "left"), parsed.where("left").select("path")
    others = iter([] if left.isEmpty() else left.toLocalIterator())
    while some := [re.sub(r"[*?\[\]{}\\]", r"\\\g<0>", row.path) for row in islice(others, max(1, listing.DRIVER_LISTS))]:
        result = result.unionByName(staged(_read(spark, some), "records"))
    return result


def _read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of files that Spark's reader lists in the driver."""
    schema = StructType.fromDDL(EBOOK_FIELDS)
    books = (
        spark.read.format("xml")
        .option("rowTag", EBOOK_TAG)
        .option("recursiveFileLookup", True)
        .schema(schema)
        .load(path)
    )
    return books.select(F.col("_metadata.file_name").alias("file_name"), *_record())


def _ebook_rows(path: str, size: int, content: bytes) -> list[tuple]:
    """``path, file_name, xml`` of each e-book; one row without XML if the file is left to Spark's reader."""
    found = None if path.endswith(listing.OTHER_CODECS) else ebooks_in(listing.plain(path, content))
    name = listing.uri(path.rpartition("/")[2])
    return [("file:" + path, name, None)] if found is None else [(None, name, xml) for xml in found]


#: The beginning of a file whose declaration, if there is one, says nothing that a reader could take in two ways.
PROLOG = re.compile(rb"""(?:\xef\xbb\xbf)?(?:<\?xml version=(["'])1\.0\1(?: encoding=(["'])(?i:utf-8)\2)?\?>)?\s*<[A-Za-z]""")


def ebooks_in(content: bytes) -> list[str] | None:
    """The e-books of an RDF file, each as it is written there; none if the file is not plain, well-formed XML."""
    if not PROLOG.match(content):
        return None
    found, inside, start = [], 0, 0
    parser, tag = expat.ParserCreate("utf-8"), EBOOK_TAG.encode()

    def begins(name: str, _: dict) -> None:
        nonlocal inside, start
        if inside or name == EBOOK_TAG:
            start = start if inside else parser.CurrentByteIndex
            inside += 1

    def ends(name: str) -> None:
        nonlocal inside
        if inside:
            inside -= 1
            if not inside:
                # After an empty element the place is that behind it, else that of the end tag.
                at = parser.CurrentByteIndex
                end = content.index(b">", at) + 1 if content.startswith(b"</" + tag, at) else at
                found.append(content[start:end].decode("utf-8"))

    parser.StartElementHandler, parser.EndElementHandler = begins, ends
    try:
        parser.Parse(content, True)
    except expat.ExpatError:
        return None
    return found


def metadata_of(documents: DataFrame, xml: str = "xml", file_name: str = "file_name") -> DataFrame:
    """Metadata records of whole RDF documents held in a string column."""
    root = F.from_xml(F.col(xml), f"struct<`{EBOOK_TAG}`: array<struct<{EBOOK_FIELDS}>>>")
    books = F.transform(root[EBOOK_TAG], lambda b: F.struct(F.lit(True).alias("found"), b.alias("book")))
    rows = rows_of(documents, books, F.col(file_name).alias("file_name"), required="found")
    return rows.select("file_name", "book.*").select("file_name", *_record())


def _record() -> list[Column]:
    return [
        ebook_id(F.col("`_rdf:about`")).alias("ebook_id"),
        subjects(F.col("`dcterms:subject`")).alias("subjects"),
        birth_year(F.col("`dcterms:creator`")).alias("birth_year"),
    ]


def ebook_id(about: Column) -> Column:
    """``ebooks/42`` -> ``42``; null for anything else."""
    return F.nullif(F.regexp_extract(about, fv.ABOUT_ID, 1), F.lit(""))


def subjects(nodes: Column) -> Column:
    """Subject elements as ``(subject_id, subject_txt)``; what is missing is null.

    Of several descriptions in one subject the last one that says something counts.
    """

    def last_said(descriptions: Column, name: str) -> Column:
        values = F.transform(descriptions, lambda d: F.nullif(d[name], F.lit("")))
        return bound(
            F.filter(values, lambda v: v.isNotNull()),
            lambda said: F.try_element_at(said, F.lit(-1)),
        )

    found = F.transform(
        nodes,
        lambda node: F.struct(
            last_said(node["rdf:Description"], "_rdf:nodeID").alias("subject_id"),
            last_said(node["rdf:Description"], "rdf:value").alias("subject_txt"),
        ),
    )
    return F.coalesce(found, F.array().cast("array<struct<subject_id:string,subject_txt:string>>"))


def birth_year(creators: Column) -> Column:
    """Year of birth of the first creator that states one."""
    years = F.transform(
        creators, lambda c: F.regexp_extract(c["pgterms:agent"]["pgterms:birthdate"], "^(-?[0-9]+)", 1).try_cast("int")
    )
    return F.try_element_at(F.filter(years, lambda y: y.isNotNull()), F.lit(1))


def with_blanks(records: DataFrame) -> DataFrame:
    """Positional variant: ``ebook_id, subjects`` with empty strings for missing parts."""
    return records.select(
        "ebook_id",
        F.transform(
            "subjects",
            lambda s: F.struct(
                F.coalesce(s["subject_id"], F.lit("")).alias("subject_id"),
                F.coalesce(s["subject_txt"], F.lit("")).alias("subject_txt"),
            ),
        ).alias("subjects"),
    )
