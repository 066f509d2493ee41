"""Training-data pipeline: five stages from raw documents to a weighted mix.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns the documents that the next stage works on, with the columns of
``documents``; the last returns the mix.  ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import decontaminate, language, lines, mixing, near
from tomewright.llm.text import unwrapped
from tomewright.sources.artifacts import staged

#: Documents are rejected whose language is less likely than this part of the least likely right prediction in training.
LEAST_PART = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter or without a likely language; learn from those not held out."""
    model = language.train(docs.where(language.learnable(docs)))
    rows = language.identified(docs, model)
    likely = F.col("score") >= LEAST_PART * model.least_right
    return unwrapped(rows.where((F.col("lang_pred") != language.UNDETERMINED) & likely))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines from the texts; a document that loses all lines stays with an empty text."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias("_no_text")).alias("_rest"))
    kept = lines.kept_lines(rows, lines.keep_bitmaps(rows))
    text = F.when(~F.col("_rest._no_text"), F.col("kept_text"))
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*[columns.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies, that of least id."""
    return near.one_of_each_class(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unwrapped(found.where(F.size("spans") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document: ``doc_id, size, source_size, target, taken``."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
]
#: A trained classifier, weighted samples and a knapsack fit are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
