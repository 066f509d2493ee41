"""Language identification (operator 2): sparse multinomial regression on TF-IDF character n-grams, by FTRL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.text import SLICES, chunks, count_slices, gathered

BITS = 16
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
ROWS_PER_LANGUAGE = 400
#: Languages that are learned, the most frequent ones; each takes a row of weights.
MOST_LANGUAGES = 200
CHUNK_CHARS = 500_000
SCALE = 20.0
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> str:
    """Lower case, with a space for any run of other characters than letters, and at both ends; empty without a letter."""
    bare = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {bare} " if any(c.isalpha() for c in bare) else ""


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of all n-grams of the texts with the text each is from, size by size."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    total = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            total = total[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in SIZES and len(total):
                inside = owner[: len(total)] == owner[n - 1 :]
                hashed = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (hashed[inside] >> np.uint64(64 - BITS)).astype(np.int64), owner[: len(total)][inside]


def _text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [normalised(t) for t in batch.column("text").to_pylist()]
        for a, b in chunks(map(len, texts), CHUNK_CHARS):
            yield batch.slice(a, b - a), texts[a:b]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of documents with each bucket."""
    count, n_docs = np.zeros(BUCKETS, np.int64), 0
    for _, texts in _text_chunks(batches):
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            seen = np.zeros((len(some), BUCKETS), bool)
            for bucket, owner in buckets(some):
                seen[owner, bucket] = True
            count += seen.sum(axis=0)
        n_docs += len(texts)
    if n_docs:
        yield count_slices(count, n_docs)


def inverse_document_frequency(rows: DataFrame) -> np.ndarray:
    """IDF of each bucket over all rows; the driver gets ``BUCKETS`` numbers, however many rows there are."""
    count, n_docs = gathered(rows.select("text").mapInArrow(_document_counts, SLICES), BUCKETS)
    return np.log((1 + n_docs) / (1 + count)) + 1


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and relative frequencies of each row."""
    for batch, texts in _text_chunks(batches):
        found, freq = [], []
        for text in texts:
            parts = [bucket for bucket, _ in buckets([text])]
            index, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0))
            found.append(index.astype(np.int32))
            freq.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("ticket"), pa.array(found, pa.list_(pa.int32())), pa.array(freq, pa.list_(pa.float32()))],
            ["lang", "ticket", "found", "freq"],
        )


def sampled(rows: DataFrame, per_language: int, seed: int, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """About ``per_language`` rows of each of the ``most_languages`` most frequent languages, by hashes of id and text."""
    ticket = F.xxhash64(F.lit(seed), "doc_id", "text")
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counted:
        return rows.withColumn("ticket", ticket).limit(0)
    shares = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, per_language / r["count"]))])
    even = F.shiftrightunsigned("ticket", 11) / float(1 << 53)
    return rows.withColumn("ticket", ticket).where(even < F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0)))


@dataclass
class LanguageModel:
    """``tables[k]`` has a language's weight of each bucket, IDF included; scores are divided by ``temperature``.

    ``least_right`` is the least probability of a right prediction among the rows that set the temperature.
    """

    languages: list[str]
    tables: np.ndarray
    temperature: float = 1.0
    least_right: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        out, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bucket, owner in buckets(texts):
            total += np.bincount(owner, minlength=len(texts))
            for k, table in enumerate(self.tables):
                out[:, k] += np.bincount(owner, table[bucket], len(texts))
        return out / np.maximum(total, 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        chance = softmax(self.scores(texts) / self.temperature)
        best = chance.argmax(axis=1)
        score = np.where([len(t) > 0 for t in texts], chance[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if t else UNDETERMINED for b, t in zip(best, texts, strict=True)], score


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 4,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001,
) -> np.ndarray:
    """Weights by follow-the-regularised-leader with per-coordinate rates and elastic-net penalties.

    ``z`` sums gradients less the pull of past weights, ``n`` squared gradients;
    a weight is zero while ``|z|`` is within ``l1``.
    """
    z, n = np.zeros((n_classes, BUCKETS)), np.zeros((n_classes, BUCKETS))

    def weights(at) -> np.ndarray:
        part = z[:, at]
        step = (beta + np.sqrt(n[:, at])) / alpha + l2
        return np.where(np.abs(part) <= l1, 0.0, (np.sign(part) * l1 - part) / step)

    for _ in range(epochs):
        for found, value, label in examples:
            w = weights(found)
            error = softmax((w @ value)[None, :])[0]
            error[label] -= 1
            gradient = error[:, None] * value
            grown = n[:, found] + gradient**2
            z[:, found] += gradient - (np.sqrt(grown) - np.sqrt(n[:, found])) / alpha * w
            n[:, found] = grown
    return weights(slice(None))


def calibrated(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by ternary search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        chance = softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(chance, 1e-300)).mean())

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(rows: DataFrame, per_language: int = ROWS_PER_LANGUAGE, seed: int = 5, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Fit on ``doc_id, text, lang``; rows without text or language do not count.

    IDF is counted over all rows.  The classifier is fitted to about
    ``per_language`` rows of each of the ``most_languages`` most frequent languages, a
    fifth of them for the temperature; these bounds alone set what comes to the driver.
    """
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = sampled(rows, per_language, seed, most_languages).select("text", "lang", "ticket")
    found = sample.mapInArrow(_sparse, "lang string, ticket long, found array<int>, freq array<float>").collect()
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    idf = inverse_document_frequency(rows)
    examples = []
    for row in sorted(found, key=lambda r: (r["ticket"], r["lang"])):
        index = np.array(row["found"], np.int64)
        if len(index):
            examples.append((index, SCALE * np.array(row["freq"]) * idf[index], languages.index(row["lang"])))
    held = examples[::5] if len(examples) >= 10 else []
    fitted = [e for i, e in enumerate(examples) if not held or i % 5]
    weights = ftrl(fitted, len(languages))
    scores = np.array([weights[:, index] @ value for index, value, _ in held]).reshape(-1, len(languages))
    temperature = calibrated(scores, np.array([label for _, _, label in held], np.int64))
    labels = np.array([label for _, _, label in held], np.int64)
    chance = softmax(scores / temperature) if len(held) else scores
    right = chance[np.arange(len(held)), labels][chance.argmax(axis=1) == labels] if len(held) else chance[:, :0]
    least = float(right.min()) if right.size else 0.0
    return LanguageModel(languages, (SCALE * weights * idf).astype(np.float32), temperature, least)


def learnable(docs: DataFrame) -> Column:
    """Documents to learn from: all but the held-out third; none without an id."""
    return F.coalesce(~_third(docs), F.lit(False))


def _third(docs: DataFrame) -> Column:
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 1


def identified(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (the document's columns, all or those in ``keep``) with ``lang_pred`` and ``score``.

    Only the text is an input of the prediction.  ``score`` is the calibrated
    probability of ``lang_pred``; a text that is null or has no letter, or any
    text if no language was learned, is ``und`` with score 0.  Repeated rows are
    judged one by one; no rows give no rows.
    """
    columns = [docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*columns).alias("doc"), docs["text"].cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _text_chunks(batches):
            lang, score = sent.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc", "lang_pred", "score"]
            )

    schema = rows.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(learnable(docs)))
    marked = docs.select("doc_id", "text", F.coalesce(_third(docs), F.lit(False)).alias("held_out"))
    return identified(marked, model, keep=["doc_id", "held_out"]).select("doc.*", "lang_pred", "score")
