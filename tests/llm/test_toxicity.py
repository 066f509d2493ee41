"""Toxicity scores against a plain computation of the model, and on held-out documents."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import corner
from tomewright.llm import toxicity as tx

LABELS = "doc_id long, toxic int, quality int, text string, `gram` string"
INSULTS = ["stupid", "idiot", "moronic", "worthless"]


def made(n, seed=0):
    """Prose of invented words, every fourth with an insult, some in longer spellings."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(stock, k=rng.randrange(5, 120))
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS) + rng.choice(["", "s", "ly"]))
        docs.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, int(i % 4 == 0), 1, "t", "g"))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def plain_shared(texts):
    """Interpolated Kneser-Ney probabilities of the shared orders, gram by gram."""
    level, orders = {g for t in texts for w in tx.words(t) for g in tx.grams(w)}, {}
    for size in range(tx.ORDER - 1, 0, -1):
        orders[size] = Counter(g[1:] for g in level)
        level = set(orders[size])

    def p(g):
        if not g:
            return 1 / len(orders[1])
        own = {x: n for x, n in orders[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        return max(own[g] - tx.DISCOUNT, 0) / total + tx.DISCOUNT * len(own) / total * p(g[1:])

    return {g: p(g) for g in orders[tx.ORDER - 1]}


def test_shared_and_class_probabilities(spark):
    docs, labels = made(24)
    shared = tx.shared_probabilities(spark.createDataFrame(docs, "doc_id long, text string"))
    want = plain_shared([t for _, t in docs])
    got = {r.gram: r.p for r in shared.collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
    by_history = defaultdict(float)
    for g, p in got.items():
        by_history[g[:-1]] += p
    assert max(by_history.values()) < 1 + 1e-9

    counts = [Counter(), Counter()]
    for (_, text), (_, toxic, *_) in zip(docs, labels):
        counts[toxic].update({g for w in tx.words(text) for g in tx.grams(w)})
    rows = [(g, counts[0][g], counts[1][g]) for g in counts[0].keys() | counts[1].keys()]
    histories, extra = tx.class_ratios(spark.createDataFrame(rows, "gram string, n0 long, n1 long"), shared)
    discount = []
    for c in counts:
        ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
        discount.append(ones / (ones + 2 * twos) if ones and twos else tx.DISCOUNT)

    def chance(c, g):
        own = {x: n for x, n in counts[c].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return want[g[1:]]
        return max(counts[c][g] - discount[c], 0) / total + discount[c] * len(own) / total * want[g[1:]]

    for g in random.Random(1).sample(sorted(extra), 200):
        assert histories[g[:-1]] + extra[g] == pytest.approx(math.log(chance(1, g) / chance(0, g)), abs=1e-9)


def test_ratio_sums_over_the_whole_text():
    model = tx.ToxicityModel({"\x02\x02\x02\x02": 0.5}, {"\x02\x02\x02ab": 1.0, "\x02ab\x03"[-5:]: 9.0}, (1.0, 0.0, 0.0, 0.0))
    assert model.ratio("Ab, ab! c") == (0.5 * 3 + 1.0 * 2, 3 + 3 + 2)
    assert model.ratio(None) == model.ratio("12 _ !") == (0.0, 0)


def test_held_out_documents(spark):
    docs, labels = made(1500)
    held = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    # Labels of held-out documents are turned round: were they learned from, scores would follow them.
    turned = [(d, 1 - t, *rest) if d in set(held) else (d, t, *rest) for d, t, *rest in labels]
    found = tx.toxicity(*frames(spark, docs, turned)).select("doc.doc_id", "score").collect()
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found if r.doc_id in set(held)]
    assert len(right) > 200 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in found) and len(found) == 1500


def test_query(spark):
    got = tx.query(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert len(got) == docs and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()


def test_corner_rows(spark):
    docs = corner.documents(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, 1, "x", "y") for i in range(15)] + [(9, None, 1, "", ""), (None, 1, 1, "", ""), (9, 1, 1, "", ""), (777, 1, 0, "", "")], LABELS
    )
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == 19 and got[0].doc.asDict().keys() == set(docs.columns)
    for r in got:
        assert 0 <= r.score <= 1 and (r.symbols == 0) == (not tx.words(r.doc.text))
    assert len({r.score for r in got if r.symbols == 0}) == 1
    assert tx.toxicity(docs.limit(0), labels).count() == 0
    for some, score in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0)):
        assert all(abs(r.score - score) < 1e-9 for r in tx.toxicity(docs, some).collect())
    assert tx.toxicity(docs.where("text is null"), labels).where("symbols <> 0").count() == 0


def test_sample_is_bounded_and_balanced(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    chosen, n = tx.sampled(labels, toxic_rows=300, ordinary_rows=2, seed=3)
    found = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    assert 200 < found[1] < 400 and 450 < found[0] < 750 and n[0] + n[1] == labels.where(tx._fifth(F.col("doc_id")) != 0).count()
    assert chosen.where(tx._fifth(F.col("doc_id")) == 0).count() == 0
