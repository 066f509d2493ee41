"""Toxicity (operator 13): class-conditional Kneser-Ney models of letters over shared backoff counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.sources.artifacts import staged

ORDER = 5
#: The classes are counted on about so many toxic documents at most, and so many ordinary ones for each of them.
TOXIC_ROWS = 4000
ORDINARY_ROWS = 2
#: Discount of the shared orders; those of the classes come from their counts.
DISCOUNT = 0.75
#: Distinct words that a task remembers.
WORDS_KEPT = 200_000
BEFORE, AFTER = "\x02", "\x03"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def grams(word: str) -> list[str]:
    """A gram for each letter of the word and for its end: the letter after the ``ORDER - 1`` symbols before it."""
    line = BEFORE * (ORDER - 1) + word + AFTER
    return [line[i : i + ORDER] for i in range(len(word) + 1)]


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of a stretch of texts."""
    seen: set[str] = set()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sorted({g for w in seen for g in grams(w)}), pa.string())], ["gram"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(words(text))
            if len(seen) > WORDS_KEPT:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a stretch of texts with the number of ordinary and of toxic ones that have them.

    A text counts once for each gram, so that a few very long ones do not set a class's language and topic.
    """
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({g for w in set(words(text)) for g in grams(w)})
        found = sorted(counts[0].keys() | counts[1].keys())
        numbers = [pa.array([c[g] for g in found], pa.int64()) for c in counts]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *numbers], ["gram", "n0", "n1"])


def _suffix(gram: str) -> Column:
    return F.substring(gram, F.lit(2), F.length(gram))


def _history(gram: str) -> Column:
    return F.substring(gram, F.lit(1), F.length(gram) - 1)


def shared_probabilities(docs: DataFrame) -> DataFrame:
    """``gram, p``: the lower orders that both classes back off to, for all grams of ``ORDER - 1`` symbols.

    A gram's count is its continuation count: before how many different symbols,
    or rather after how many, it occurs in any document.  They come from the distinct
    grams of all texts, so they grow with the documents; each order is discounted and
    interpolated with the next shorter one, the shortest with a uniform share.
    """
    every = staged(docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_distinct_grams, "gram string").distinct(), "toxicity_grams")
    orders = []
    for _ in range(ORDER - 1):
        every = every.groupBy(_suffix("gram").alias("gram")).agg(F.count("*").alias("n"))
        every = staged(every, "toxicity_counts")
        orders.append(every)
    shorter = None
    for counts in reversed(orders):
        own = counts.withColumn("history", _history("gram"))
        sums = own.groupBy("history").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        rows = own.join(sums, "history")
        kept, passed = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total"), DISCOUNT * F.col("types") / F.col("total")
        if shorter is None:
            shorter = rows.select("gram", (kept + passed / F.col("types")).alias("p"))
        else:
            below = shorter.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            shorter = rows.withColumn("suffix", _suffix("gram")).join(below, "suffix").select("gram", (kept + passed * F.col("below")).alias("p"))
    return shorter


def class_ratios(counts: DataFrame, shared: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log ratios of toxic to ordinary probability: what a history passes on, and what a counted gram adds to that.

    A class counts documents.  In it, a gram has its discounted share of the history's count, and the
    shared probability of its suffix by what the discounts left.  A gram that the
    classes never had differs by its history alone; without that, not at all.
    """
    counts = staged(counts, "toxicity_classes")
    found = counts.agg(
        *[F.count_if(F.col(f"n{c}") == k).alias(f"n{c}_{k}") for c in (0, 1) for k in (1, 2)],
    ).first()
    discount = [found[f"n{c}_1"] / (found[f"n{c}_1"] + 2 * found[f"n{c}_2"]) if found[f"n{c}_1"] and found[f"n{c}_2"] else DISCOUNT for c in (0, 1)]
    own = counts.withColumns({"history": _history("gram"), "suffix": _suffix("gram")})
    sums = own.groupBy("history").agg(
        *[F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)], *[F.count_if(F.col(f"n{c}") > 0).alias(f"types{c}") for c in (0, 1)]
    )
    passed = [F.when(F.col(f"total{c}") > 0, discount[c] * F.col(f"types{c}") / F.col(f"total{c}")).otherwise(1.0) for c in (0, 1)]
    base = (F.log(passed[1]) - F.log(passed[0])).alias("base")
    rows = own.join(sums, "history").join(shared.select(F.col("gram").alias("suffix"), "p"), "suffix")
    kept = [F.when(F.col(f"total{c}") > 0, F.greatest(F.col(f"n{c}") - discount[c], F.lit(0.0)) / F.col(f"total{c}")).otherwise(0.0) for c in (0, 1)]
    chance = [kept[c] + passed[c] * F.col("p") for c in (0, 1)]
    extra = (F.log(chance[1]) - F.log(chance[0]) - base).alias("extra")
    return {r["history"]: r["base"] for r in sums.select("history", base).collect()}, {r["gram"]: r["extra"] for r in rows.select("gram", extra).collect()}


@dataclass
class ToxicityModel:
    """Log ratios, and the weights of ``features`` and the constant that make up the score's log odds."""

    histories: dict[str, float] = field(default_factory=dict)
    counted: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def __getstate__(self) -> tuple:
        return self.histories, self.counted, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.histories, self.counted, self.weights = state
        self.known = {}

    def word(self, word: str) -> float:
        """Log of how much likelier the word is among toxic documents."""
        each = grams(word)
        return sum(self.histories.get(g[:-1], 0.0) for g in each) + sum(self.counted.get(g, 0.0) for g in each)

    def ratio(self, text: str | None) -> tuple[float, int]:
        """The text's log ratio and its number of symbols, word ends included."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known, total, found = self.known, 0.0, words(text)
        for word in found:
            value = known.get(word)
            if value is None:
                value = known[word] = self.word(word)
            total += value
        return total, sum(map(len, found)) + len(found)


def features(ratio: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Log ratio by length, a hundred symbols at a time, and by the root of the length, in which chance grows; log of the length."""
    length = np.maximum(symbols, 1)
    return np.column_stack([100 * ratio / length, ratio / np.sqrt(length), np.log1p(symbols), np.ones(len(ratio))])


def odds(x: np.ndarray, label: np.ndarray, share: float, rounds: int = 100, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps, halved until the loss falls, rows weighted so that ``share`` of them are toxic.

    Features are brought to one spread first; the last one is the constant.
    """
    spread = np.append(np.maximum(x[:, :-1].std(axis=0), 1e-9), 1.0)
    x = x / spread
    weight = np.where(label == 1, share / max(1, (label == 1).sum()), (1 - share) / max(1, (label == 0).sum())) * len(label)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    here = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - label)) + ridge * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w)), slope)
        while np.abs(step).max() > 1e-10 and loss(w - step) >= here:
            step = step / 2
        if np.abs(step).max() <= 1e-10:
            break
        w, here = w - step, loss(w - step)
    return w / spread


def _fifth(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sampled(labels: DataFrame, toxic_rows: int, ordinary_rows: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, toxic, tried`` of about so many labelled documents, and the number of all by label.

    A fifth is ``tried``: it fits the score, the others the classes.  Documents held
    out are none of them.  Of several labels of an id the largest counts; missing ones do not.
    """
    known = labels.select(labels["doc_id"].alias("doc_id"), (labels["toxic"] > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    one = known.where(_fifth(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = staged(one, "toxicity_labels")
    n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    shares = [min(1.0, ordinary_rows * min(n[1], toxic_rows) / max(1, n[0])), min(1.0, toxic_rows / max(1, n[1]))]
    ticket = F.xxhash64(F.lit(seed), "doc_id")
    even = F.shiftrightunsigned(ticket, 11) / float(1 << 53)
    rows = one.where(even < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    return rows.select("doc_id", "toxic", (F.pmod(ticket, F.lit(5)) == 0).alias("tried")), n


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, seed: int = 3) -> ToxicityModel:
    """Fit on ``doc_id, text`` and ``doc_id, toxic``.

    The backoff counts cover all documents.  The classes are counted on a sample
    that ``toxic_rows`` and ``ordinary_rows`` bound, as is what is broadcast: the
    sample's ids, and the log ratios of its grams.  Without both labels every score is the share of toxic ones.
    """
    chosen, n = sampled(labels, toxic_rows, ordinary_rows, seed)
    share = n[1] / max(1, n[0] + n[1])
    if not n[0] or not n[1]:
        return ToxicityModel(weights=(0.0, 0.0, 0.0, 40.0 if share else -40.0))
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    # Some thousand ids: the texts stay where they are.
    rows = staged(texts.join(F.broadcast(chosen), "doc_id"), "toxicity_rows")
    counts = rows.where("not tried").select("text", "toxic").mapInArrow(_class_grams, "gram string, n0 long, n1 long")
    counts = counts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    model = ToxicityModel(*class_ratios(counts, shared_probabilities(docs)))
    measured = ratios(rows, model, ["doc_id", "toxic", "tried"]).groupBy("doc.doc_id", "doc.toxic", "doc.tried")
    found = measured.agg(F.avg("ratio").alias("ratio"), F.avg("symbols").alias("symbols")).toPandas().sort_values("doc_id")
    tried = found[found["tried"]]
    # Rows that the classes have counted look better than others; they are used only if there are no others.
    found = tried if tried["toxic"].nunique() == 2 else found
    if found["toxic"].nunique() == 2:
        x = features(found["ratio"].to_numpy(), found["symbols"].to_numpy())
        model.weights = tuple(odds(x, found["toxic"].to_numpy(), share).tolist())
    else:
        model.weights = (0.0, 0.0, 0.0, float(np.log(share / (1 - share))))
    return model


def ratios(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (the document's columns, all or those in ``keep``), its log ``ratio``, ``symbols`` and ``score``."""
    columns = [docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*columns).alias("doc"), docs["text"].cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sent.value.ratio(text) for text in batch.column("text").to_pylist()]
            ratio, symbols = np.array([r for r, _ in each], np.float64), np.array([n for _, n in each], np.int64)
            score = 1 / (1 + np.exp(-np.clip(features(ratio, symbols) @ np.array(sent.value.weights), -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(ratio, pa.float64()), pa.array(symbols, pa.int64()), pa.array(score, pa.float64())],
                ["doc", "ratio", "symbols", "score"],
            )

    schema = rows.select("doc", F.lit(0.0).alias("ratio"), F.lit(0).cast("long").alias("symbols"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(measured, schema)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """``doc`` (the document's columns, all or those in ``keep``), ``ratio``, ``symbols`` and ``score`` of every document.

    ``ratio`` is the log likelihood of the whole text among toxic documents less
    that among ordinary ones, ``score`` the probability that the label is 1, from the ratio
    by length.  Only the text is an input of either.  A null text, or one without a
    letter, has no symbols, the ratio 0 and the score of a text that says nothing.
    Repeated rows are judged one by one, those without id too; no rows give no rows.
    Labels without id or value do not count; without labels of both values all scores are 0 or 1.
    """
    return ratios(docs, train(docs, labels, **options), keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    marked = docs.select("doc_id", "text", F.coalesce(_fifth(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    found = toxicity(marked, labels, ["doc_id", "held_out"])
    return found.select("doc.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
