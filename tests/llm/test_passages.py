"""Repeated passages where blocks, words and hashes are unkind."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_sql_twins import brute_passages
from tomewright.llm import near, passages


def crowded_documents():
    """Long texts side by side in id, many rows without id, an id with many rows, and ids beyond 2^53."""
    made = random.Random(5)
    common = [" ".join(f"c{k}_{i}" for i in range(40)) for k in range(6)]

    def text(n, k):
        own = [f"w{made.randrange(10**6)}" for _ in range(n)]
        return " ".join([*own[: made.randrange(n)], common[k % 6], *own])

    ids = [*range(60), *[None] * 60, *[7] * 40, *range(1 << 60, (1 << 60) + 20)]
    return [(i, text(900 if i is not None and 20 <= i < 30 else 30, k)) for k, i in enumerate(ids)]


def found(docs, most):
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in passages.dedup_passages(docs, most).collect())


def wanted(rows):
    return sorted(str((i, *r)) for (i, _), r in zip(rows, brute_passages(rows), strict=True))


def test_blocks_hold_bytes_not_rows(spark):
    rows = crowded_documents()
    docs, most = spark.createDataFrame(rows, "doc_id long, text string"), 9_000
    table, first, shared = passages._blocks(docs, most)
    sizes = table.groupBy("block").agg(F.sum(F.octet_length("text") + 32).alias("size"), F.count_distinct("doc_id").alias("ids")).collect()
    longest = max(len(t) for _, t in rows) + 32
    # Rows of one id are spread by a hash, so some of its blocks are somewhat larger.
    assert all(r["size"] <= (2 * most if shared[r.block] else max(most, longest)) for r in sizes)
    assert shared.sum() >= 4 and sum(r["size"] for r in sizes) == sum(len(t) + 32 for _, t in rows)
    assert found(docs, most) == wanted(rows)


def test_more_blocks_than_buckets(spark):
    """Spark bounds the buckets of a table; several blocks share one then."""
    rows, name = crowded_documents(), "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(name)
    spark.conf.set(name, "20")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert len(passages._blocks(docs, 3_000)[1]) > 20
        assert found(docs, 3_000) == wanted(rows)
    finally:
        spark.conf.set(name, before)


def test_more_words_than_letters():
    words = [b"%x" % i for i in range(1_150_000)]
    data = [b" ".join(words), b" ".join([b"before", *words, b"after"])]
    every = np.unique(passages.windows(*passages.word_hashes(data))[1])
    candidates = passages.Candidates(data, every)
    gone = passages.removed_words([d.split() for d in data], [1, 2], candidates, np.zeros(len(candidates.keys), bool))
    assert not gone[0].any() and gone[1][1:-1].all() and not gone[1][0] and not gone[1][-1]


def thue_morse(n, turned=0):
    return "".join("ab"[(bin(i).count("1") + turned) % 2] for i in range(n))


def test_words_on_which_polynomials_collide(spark):
    """Such words share a hash for every base if that is a polynomial modulo a power of two."""
    for n in (8, 1024, 2048, 4096, 8192):
        for hashes in passages.word_hash_pairs([f"{thue_morse(n)} {thue_morse(n, 1)}".encode()])[:2]:
            assert hashes[0] != hashes[1]
    shared = [f"w{i}" for i in range(25)]
    rows = [(d, " ".join([*shared[:10], thue_morse(1024, d - 1), *shared[10:]])) for d in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, 1 << 20) == wanted(rows)
    assert [r.n_removed for r in passages.dedup_passages(docs).collect()] == [0, 0]
    short = spark.createDataFrame([(d, thue_morse(1024, d) * 2) for d in (0, 1)], "doc_id long, text string")
    assert {r.class_size for r in near.near_duplicates(short).collect()} == {1}


def test_equal_words_have_equal_hashes():
    made = random.Random(1)
    words = ["".join(made.choice("abcdé") for _ in range(made.randrange(1, 40))) for _ in range(3000)] + ["x" * 5000, "y" * 5000, "x" * 5001]
    texts = [" ".join(made.choices(words, k=400)).encode() for _ in range(20)] + [b"", b" \n ", " ".join(words).encode()]
    first, second, owner = passages.word_hash_pairs(texts)
    flat = [(w, k) for k, t in enumerate(texts) for w in t.split()]
    assert [k for _, k in flat] == owner.tolist()
    for hashes in (first, second):
        by_word = {}
        assert all(by_word.setdefault(w, h) == h for (w, _), h in zip(flat, hashes.tolist(), strict=True))
        assert len(set(by_word.values())) == len(by_word)
    assert not (first == second).any()
