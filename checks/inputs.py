"""Inputs that both engines derive from the given tables by the same expressions.

The tables hold plain texts; book files with header and footer and RDF records
are put around them here.  All expressions are valid in Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.header import BookFormat

STOP_WORDS = ["the", "of", "and", "is", "le", "la", "des", "hous", "Er", "is", ""]

# The files are invented, and so is their publisher.
FORMAT = BookFormat("MERIDIAN PRESS")

_ID = "cast(doc_id as string)"
_LANGUAGE = "case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' else 'Esperanto' end"
_ENCODING = (
    "case when doc_id % 4 = 0 then 'UTF-8' when (doc_id + copy) % 3 = 0 then 'ASCII' "
    "when (doc_id + copy) % 3 = 1 then 'utf-8' else 'ISO-8859-1' end"
)
_MARKER = (
    "concat('*** ', '{side} OF ', case when doc_id % 10 = 6 then 'THE' else 'THIS' end, "
    f"' {FORMAT.publisher} EBOOK T', {_ID}, ' ***', chr(10))"
)
_START, _END = _MARKER.format(side="START"), _MARKER.format(side="END")

# Variants by doc_id % 10: 1 no start marker, 2 two of them, 3 two end markers,
# 4 no id, 5 the older id form, 6 the other article, 7 no charset line.
CONTENT = f"""concat(
    'Title: ', case when doc_id % 17 = 0 then 'Human Genome Project' else concat('Tale ', {_ID}) end, chr(10),
    'Language: ', {_LANGUAGE}, chr(10),
    case when doc_id % 10 = 7 then '' else concat('Character set encoding: ', {_ENCODING}, chr(10)) end,
    case when doc_id % 10 = 4 then '' when doc_id % 10 = 5 then concat('[Etext #', {_ID}, ']', chr(10))
         else concat('[EBook #', {_ID}, ']', chr(10)) end,
    case when doc_id % 10 = 1 then '' when doc_id % 10 = 2 then concat({_START}, {_START}) else {_START} end,
    text, ' copy ', cast(copy as string), chr(10),
    case when doc_id % 10 = 3 then concat({_END}, 'between', chr(10), {_END}) else {_END} end,
    'License text follows')"""
PATH = f"concat('books/', {_ID}, '-', cast(copy as string), '.txt')"

_SUBJECT = (
    "concat('<dcterms:subject><rdf:Description', {node}, '><rdf:value>', {value}, "
    "'</rdf:value></rdf:Description></dcterms:subject>')"
)
_NODE = f"""concat(' rdf:nodeID="N', {_ID}, '"')"""
# doc_id % 5 = 0: second subject without node id; doc_id % 11 = 0: no about attribute;
# doc_id % 9 = 0: a second e-book, without subjects, in the same file.
RDF = f"""concat(
    '<?xml version="1.0" encoding="utf-8"?><rdf:RDF xmlns:rdf="urn:rdf" xmlns:dcterms="urn:dc" xmlns:pgterms="urn:pg">',
    '<pgterms:ebook', case when doc_id % 11 = 0 then '' else concat(' rdf:about="ebooks/', {_ID}, '"') end, '>',
    '<dcterms:creator><pgterms:agent><pgterms:birthdate>', cast(1700 + n_chars % 250 as string),
    '</pgterms:birthdate></pgterms:agent></dcterms:creator>',
    {_SUBJECT.format(node=_NODE, value="lang")},
    {_SUBJECT.format(node=f"case when doc_id % 5 = 0 then '' else {_NODE} end", value="source")},
    '</pgterms:ebook>',
    case when doc_id % 9 = 0 then concat('<pgterms:ebook rdf:about="ebooks/x', {_ID}, '"><dcterms:creator/></pgterms:ebook>') else '' end,
    '</rdf:RDF>')"""
RDF_NAME = f"concat('pg', {_ID}, '.rdf')"


# Partitions that a table is dealt into first.  The given tables are single files of one row group,
# which one task would read and work on alone; none by default, the bench sets it.
PARTS: int | None = None


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = rows.select(*columns) if columns else rows
    return rows.repartition(PARTS) if PARTS else rows


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", *columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "text")


def editions(spark: SparkSession, sf_dir: str, copies: int = 3) -> DataFrame:
    """Book-file rows: ``copies`` editions of each document."""
    numbers = F.array(*[F.lit(c).cast("bigint") for c in range(copies)])
    rows = texts(spark, sf_dir, "text", "lang").select("*", F.explode(numbers).alias("copy"))
    return rows.select(
        F.expr(PATH).alias("path"),
        F.expr(f"replace({PATH}, 'books/', '')").alias("file_name"),
        F.expr(CONTENT).alias("content"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions(spark, sf_dir, copies=1)


def rdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "lang", "source", "n_chars")
    return rows.select(F.expr(RDF_NAME).alias("file_name"), F.expr(RDF).alias("xml"))


def editions_sql(copies: int = 3) -> str:
    numbers = ", ".join(f"({c})" for c in range(copies))
    return (
        f"select doc_id, copy, {PATH} as path, {CONTENT} as content, text "
        f"from documents cross join (values {numbers}) as c(copy)"
    )
