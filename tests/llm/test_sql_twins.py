"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from checks import compare
from tests.llm import corner
from tomewright.llm import decontaminate, exact, lines, passages
from tomewright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    good, note = compare.compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert good, note


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def corner_folder(spark, tmp_path_factory):
    """The corner rows with one row for each id, as SQL means them."""
    folder = str(tmp_path_factory.mktemp("corner"))
    docs = corner.documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    rows = [(1, corner.prose(99, 30)), (2, "日本 ñandú"), (3, None), (4, ""), (None, corner.prose(9, 12)), (1, "one"), (5, corner.prose(9, 12))]
    spark.createDataFrame(rows, "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(SQL))
def test_corner_rows_as_sql(spark, corner_folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.register(table, spark.read.parquet(f"{corner_folder}/{table}.parquet").toArrow())
    good, note = compare.compare(spark, con, corner_folder, name, QUERIES[name], SQL[name])
    assert good, note


def empty(spark):
    return corner.documents(spark).limit(0)


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert exact.exact_groups(empty(spark)).count() == 0
    assert lines.dedup_lines(empty(spark)).count() == 0
    assert passages.dedup_passages(empty(spark)).count() == 0
    assert decontaminate.contamination(empty(spark), benchmark).count() == 0
    found = decontaminate.digest(decontaminate.contamination(corner.documents(spark), benchmark))
    assert found.where("contaminated").count() == 0 and found.count() == 19


def test_exact_collisions_are_chained(spark):
    """With three bits of hash most texts collide; bytes tell them apart."""
    docs = corner.documents(spark)
    want = sorted(map(tuple, exact.exact_groups(docs).collect()), key=str)
    assert sorted(map(tuple, exact.exact_groups(docs, bucket_bytes=1000, hash_bits=3).collect()), key=str) == want
    by_id = {(r[0], r[4]): r for r in want}
    same = [r for r in want if r[2] == 3]
    # Two groups of three: one text under 9, 9 and no id; two nulls and an empty text.
    assert sorted((str(r[0]), r[1]) for r in same) == [("0", 1), ("1", 1), ("9", 9), ("9", 9), ("None", 1), ("None", 9)]
    assert all(r[3] == (r[0] == r[1]) for r in by_id.values())


def test_directory_doubles(spark):
    import numpy as np

    weights = np.array([10, 0, 0, 0, 1, 1, 1, 1])
    directory = exact.Directory.over(weights, 3)
    assert directory.depth == 3 and len(directory.slots) == 8
    for bucket, depth in enumerate(directory.local):
        held = [i for i, b in enumerate(directory.slots) if b == bucket]
        assert len(held) == 1 << (directory.depth - depth) and held == list(range(held[0], held[-1] + 1))
        assert weights[held].sum() <= 3 or depth == 3


def test_line_dedup_of_repeated_ids(spark):
    docs = corner.documents(spark)
    got = lines.dedup_lines(docs).collect()
    assert len(got) == 19
    bitmaps = {r.doc_id: r for r in lines.keep_bitmaps(docs).collect()}
    # The passage is a line of 4, 13 and 14.
    assert set(bitmaps) == {4, 5, 6, 13} and (bitmaps[6].drop_first, bitmaps[6].drop_last) == ([0, 2], [0, 2])
    assert {r.doc_id: r.n_dropped for r in got}[12] == 0


def brute_passages(rows):
    first, out = {}, []
    order = [((i is None, i or 0), (t or "").encode().split()) for i, t in rows]
    for i, w in order:
        for s in range(len(w) - passages.WINDOW + 1):
            key = tuple(w[s : s + passages.WINDOW])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, w in order:
        gone = set()
        for s in range(len(w) - passages.WINDOW + 1):
            if first[tuple(w[s : s + passages.WINDOW])] < (i, s):
                gone.update(range(s, s + passages.WINDOW))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 20_000])
def test_passages_against_brute_force(spark, monkeypatch, block_bytes):
    docs = corner.documents(spark)
    rows = corner.plain(docs)
    monkeypatch.setattr(passages, "AUTOMATON_WORDS", 300)
    got = passages.dedup_passages(docs, block_bytes).collect()
    want = [(i, *r) for (i, _), r in zip(rows, brute_passages(rows), strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in got)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_contamination_in_blocks(spark, block_bytes):
    items = [(f"i{k}", corner.prose(k, 15)) for k in range(30)] + [("short", "one"), ("twice", corner.prose(3, 15))]
    texts = [(d, corner.prose(100 + d, 20) + " " + corner.prose(d % 40, 15)[4:] + " One, " + corner.prose(d, 3)) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes)
    got = {r.doc.doc_id: ([tuple(s) for s in r.spans], r.items) for r in found.collect()}
    windows = {}
    for name, text in items:
        w = decontaminate.plain_words(text.encode())
        n = min(len(w), decontaminate.WINDOW)
        for s in range(len(w) - n + 1):
            windows.setdefault(tuple(w[s : s + n]), set()).add(name)
    for d, text in texts:
        w, hit, names = decontaminate.plain_words(text.encode()), set(), set()
        for n in (1, decontaminate.WINDOW):
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    names |= windows[tuple(w[s : s + n])]
        assert got[d][1] == sorted(names)
        assert {p for s, e in got[d][0] for p in range(s, e)} == hit


def test_first_lines_are_streamed_from_sorted_ranges(spark):
    """Sort, window and range partitioning are in the plan that runs, and nothing else is shuffled before it."""
    rows = [(h, 0, d, p) for h in range(4) for d in range(5) for p in (7, 3, 5)]
    hashed = spark.createDataFrame(rows, "h1 long, h2 long, doc_id long, place int")
    first = lines.first_occurrences(hashed)
    assert sorted(tuple(r) for r in first.collect()) == [(h, 0, d, 3) for h in range(4) for d in range(5)]
    plan = first._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Window" in plan and "Sort" in plan and plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Python" not in plan
