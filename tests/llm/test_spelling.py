"""Spelling variants against a comparison of every word with every other."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import corner
from tomewright.llm import spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(a) == len(b) + 1 and a[k + 1 :] == b[k:])


def brute(rows):
    words, out = counted(rows), {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, n, len(near))
    table = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        table.append((w, form, root, n, near, words[form] if form else None))
    return sorted(table)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_is_that_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(corner.plain(docs.select("doc_id", "text")))
    assert result(spelling.query(spark, SF)) == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] and r[1] for r in want)


def test_corner_rows(spark):
    docs = corner.documents(spark)
    assert result(spelling.spelling_variants(docs)) == brute(corner.plain(docs))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains_ties_and_places(spark):
    """A chain of many forms, ties of counts, and edits at both ends, in the middle and at repeated letters."""
    word, texts, n = "abcdefghijklmnop", [], 3
    for k in range(6):
        texts.append((word[: len(word) - k] + " ") * n)
        n *= 2
    texts += ["aaaaaa " * 3, "aaaaa " * 7, "aaaaaab " * 7, "baaaaaa " * 3, "xyzuv " * 4, "xyzuw " * 8, "xyzux " * 8, "yzuvé " * 3, "Yzuvè " * 9]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(spelling.spelling_variants(docs)) == want
    chain = {w: root for w, _, root, *_ in want}
    assert chain["abcdefghijklmnop"] == "abcdefghijk" and {w: f for w, f, *_ in want}["xyzuv"] == "xyzuw"


WORD = st.text("ab", min_size=5, max_size=9)


@settings(max_examples=6, deadline=None)
@given(st.sets(WORD, min_size=2, max_size=120))
def test_every_near_pair_is_met_once(spark, words):
    found = spelling.near_pairs(spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")).select("long", "short").collect()
    pairs = sorted(tuple(sorted(p)) for p in found)
    assert pairs == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_chunks_and_grams(spark):
    words = spark.createDataFrame([("abcdefg", 3)], "word string, n long")
    assert [(r.gram, r.place) for r in spelling.chunks_of(words).orderBy("place").collect()] == [("abc", 0), ("efg", 4)]
    grams = spelling.grams_of(words).where("size = 7").orderBy("at").collect()
    assert [(r.gram, r["at"]) for r in grams] == [("abc", 0), ("bcd", 1), ("def", 3), ("efg", 4)]


def test_runs_are_counted_before_the_shuffle(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    plan = spelling.words_of(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Python" not in plan
