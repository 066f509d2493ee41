"""Line dedup (operator 1): range-partitioned line hashes, and run-length bitmaps of the lines that stay."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.functions.binding import bound
from tomewright.llm.text import whole_rows
from tomewright.sources.artifacts import staged

MIN_CHARS = 20
MIN_DOCS = 3
WHITE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z in lower case and no other letter changed."""
    bare = F.btrim(line, F.lit(WHITE))
    # Lower-casing by Unicode does the same to ASCII and is much faster there.
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def text_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def first_occurrences(hashed: DataFrame) -> DataFrame:
    """``h1, h2, doc_id, place`` of the first line with a hash in each document.

    Rows are dealt by ranges of hash and document and sorted by hash, document and
    position; the first of each run of rows is passed on as they stream by.  The ranges
    already hold a document's lines of one hash together, so nothing is shuffled again.
    """
    ranged = hashed.where(F.col("doc_id").isNotNull()).select("h1", "h2", "doc_id", "place").repartitionByRange("h1", "h2", "doc_id")
    in_order = Window.partitionBy("h1", "h2", "doc_id").orderBy("place")
    return ranged.withColumn("turn", F.row_number().over(in_order)).where("turn = 1").drop("turn")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the lines that stay, for documents that lose any: ``doc_id, text_key, drop_first, drop_last``.

    A bitmap is stored as runs: line ``drop_first[i]`` to ``drop_last[i]``, counted
    from zero, go, all others stay.  No text is returned.

    The narrow table of line hashes is written once, partitioned by ranges of
    hash, document and position, so that a line which every document holds
    spreads over as many tasks as it has rows, and first occurrences are streamed
    from sorted rows.  What is counted per hash was reduced to one row per
    document before; the hash has 128 bits.
    """
    line = docs.select(
        docs["doc_id"].alias("doc_id"), text_key(docs).alias("text_key"), F.posexplode(lines_of(docs["text"])).alias("place", "line")
    )
    keyed = line.select("doc_id", "text_key", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = staged(
        keyed.select("doc_id", "text_key", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "line_hashes",
    )
    common = first_occurrences(hashed).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))
    # Written, so that the join below shuffles both sides by itself and can split the rows of a hash that many documents hold.
    common = staged(common.where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_id"), "common_lines")
    gone = hashed.join(common, ["h1", "h2"]).where(F.col("doc_id") < F.col("last_id"))
    places = gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("place")).alias("places"))

    def runs(d: Column) -> Column:
        first = F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1) != x - 1))
        last = F.filter(d, lambda x, i: (i == F.size(d) - 1) | (F.get(d, i + 1) != x + 1))
        return F.struct(first.alias("drop_first"), last.alias("drop_last"))

    return places.select("doc_id", "text_key", bound(F.col("places"), runs).alias("run")).select("doc_id", "text_key", "run.*")


def kept_lines(docs: DataFrame, bitmaps: DataFrame, text: str = "kept_text") -> DataFrame:
    """``docs`` with ``text`` (kept lines joined by a line feed), ``n_lines`` and ``n_dropped`` added."""
    rows = whole_rows(docs, own_key=text_key(docs))
    marks = bitmaps.select(
        F.col("doc_id").alias("marked_id"), F.col("text_key").alias("marked_key"), F.col("drop_first").alias("_first"), F.col("drop_last").alias("_last")
    )
    found = rows.join(marks, (F.col("doc.doc_id") == F.col("marked_id")) & (F.col("own_key") == F.col("marked_key")), "left")

    def part(lines: Column) -> Column:
        def stretch(j: Column) -> Column:
            after = F.coalesce(F.get("_last", j - 1), F.lit(-1))
            return F.slice(lines, after + 2, F.coalesce(F.get("_first", j), F.size(lines)) - after - 1)

        kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_first")), stretch))
        whole = F.coalesce(F.col("doc.text"), F.lit(""))
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            F.when(F.col("_first").isNull(), whole).otherwise(F.array_join(kept, "\n")).alias("text"),
        )

    runs = F.zip_with(F.col("_first"), F.col("_last"), lambda a, b: (b - a + 1).cast("long"))
    dropped = F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long"))
    kept = found.select("doc", bound(lines_of(F.col("doc.text")), part).alias("part"), dropped.alias("n_dropped"))
    return kept.select("doc.*", F.col("part.text").alias(text), F.col("part.n_lines").alias("n_lines"), "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines that many documents hold, except in the document of largest id: ``doc_id, kept_text, n_lines, n_dropped``.

    Lines end at a line feed.  They are compared by ``line_key``; keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose
    all their lines but those of the largest ``doc_id`` that holds them.  A null
    or empty text is one empty line.  A null ``doc_id`` counts as no document,
    and its lines stay.  Rows that repeat a ``doc_id`` count as one document and
    are returned one by one.  No rows give no rows.  Other columns are not read.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return kept_lines(rows, keep_bitmaps(rows, min_chars, min_docs)).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
with l as (
    select doc_id, place, lines[place] as line, len(lines) as n_lines
    from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as place
          from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))
),
k as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key
    from l
),
c as (
    select key, max(doc_id) as last_id from k where length(key) >= {MIN_CHARS}
    group by key having count(distinct doc_id) >= {MIN_DOCS}
)
select doc_id, max(n_lines) as n_lines, count(*) filter (doc_id < last_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (last_id is null or doc_id >= last_id), '')) as kept_sha256
from k left join c on k.key = c.key
group by doc_id
"""
