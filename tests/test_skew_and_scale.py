"""The ways taken for large or skewed data give the same rows as the plain ways."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from checks import inputs, queries
from tomewright.functions import words
from tomewright.operators import extract, postings as index, profiles as pf, sampling, vectors as vec, weights as wt
from tomewright.sources.artifacts import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def profile(spark):
    return queries.staged_profile(spark, SF)


def rows(df, *columns):
    return collections.Counter(map(tuple, df.select(*columns).collect()))


def test_vocabulary_joins_agree(spark, profile):
    words = staged(wt.vocabulary(profile), "vocabulary")
    plain = wt.term_frequency(profile).join(words, "term")
    whole = wt.with_vocabulary(wt.term_frequency(profile), words)
    split = wt.with_vocabulary(wt.term_frequency(profile), words, broadcast_bytes=0)
    columns = ("doc_id", "term", "n", "tf", "df", "idf")
    assert rows(plain, *columns) == rows(whole, *columns) == rows(split, *columns)


def test_one_term_in_a_third_of_all_rows(spark):
    texts = [(i, "hot" if i % 2 else f"hot w{i} v{i}") for i in range(600)]
    profile = staged(pf.profiles(spark.createDataFrame(texts, "doc_id bigint, text string")), "profiles")
    weighed = wt.tfidf(profile, broadcast_bytes=0)
    assert weighed.count() == 600 + 2 * 300
    assert weighed.where("term = 'hot' and idf = 0").count() == 600


def test_hot_terms_are_few(spark, profile):
    words = wt.document_frequency(profile)
    total = words.agg(F.sum("df")).first()[0]
    assert words.where(F.col("df") >= total * wt.HOT_SHARE).count() <= 1 / wt.HOT_SHARE


def test_posting_blocks_lose_nothing(spark, profile):
    tidy = index.postings(profile)
    lists = index.posting_lists(tidy, 10)
    assert lists.where("blocks > 1").count() > 0
    assert lists.groupBy("term").count().where("count > 1").count() > 0
    again = lists.select("term", "df", F.inline("postings"))
    assert rows(again, "term", "df", "doc_id", "n") == rows(tidy, "term", "df", "doc_id", "n")


def test_merged_postings_of_a_name_shared_by_a_third_of_the_files(spark):
    files = spark.createDataFrame(
        [(i, "shared" if i % 3 == 0 else f"f{i}", f"common w{i}") for i in range(90)], "path int, name string, text string"
    )
    counts = staged(pf.merged(pf.profiles(files, "path", carry=["name"]), "name"), "counts")
    found = {(r.term, r.name): (r.df, r.n) for r in index.merged_postings(counts, "name").collect()}
    assert len(found) == 61 + 90
    assert found["common", "shared"] == (61, 30) and found["w3", "shared"] == (1, 1)


def test_top_terms_are_cut_before_the_shuffle(spark, profile):
    plan = plan_of(wt.top_terms(wt.tfidf(profile), 5))
    assert plan.count("WindowGroupLimit") == 2, plan


def test_editions_of_one_book_in_a_third_of_all_rows(spark):
    made = [(f"p{i:04}", "hot" if i % 3 == 0 else f"d{i}", i % 7, f"b{i}") for i in range(900)]
    random.Random(1).shuffle(made)
    docs = spark.createDataFrame(made, "path string, doc_id string, enc_rank int, body string").repartition(16)
    kept = {r.doc_id: r for r in extract.best_edition(docs).collect()}
    assert len(kept) == 601
    assert (kept["hot"].enc_rank, kept["hot"].path) == (6, "p0006")


@pytest.mark.parametrize("options", [{}, {"ignore_case": True}, {"stop_raw": False}, {"min_term_len": 2}])
def test_joined_stop_list_equals_the_probed_one(spark, options):
    docs = inputs.documents(spark, SF)
    # Two rows of one key keep a profile each.
    docs = docs.union(spark.createDataFrame([(1, "The cat of Er"), (1, "cats and er")], docs.schema))
    stop = spark.createDataFrame([(word,) for word in inputs.STOP_WORDS], "word string")
    probed = pf.profiles(docs, stop_words=inputs.STOP_WORDS, **options)
    joined = pf.profiles(docs, stop_words=stop, **options)
    assert rows(pf.term_counts(probed), "doc_id", "term", "n") == rows(pf.term_counts(joined), "doc_id", "term", "n")
    assert rows(probed, "doc_id", "max_n") == rows(joined, "doc_id", "max_n")


def test_joined_stop_list_can_keep_empty_documents(spark):
    docs = spark.createDataFrame([(1, "the"), (2, "cat")], "doc_id bigint, text string")
    stop = spark.createDataFrame([("the",), ("a",)], "word string")
    for words in (stop, ["the", "a"]):
        found = pf.profiles(docs, stop_words=words, drop_empty=False)
        assert {(r.doc_id, r.max_n, len(r.terms)) for r in found.collect()} == {(1, None, 0), (2, 1, 1)}


def test_long_hot_term_and_repeated_paths(spark):
    rule = "_" * 70
    texts = spark.createDataFrame([(i, f"{rule} w{i}") for i in range(300)], "doc_id bigint, text string")
    profile = staged(pf.profiles(texts), "profiles")
    found = wt.tfidf(profile, broadcast_bytes=0)
    assert found.where(F.col("term") == rule).count() == 300 and found.count() == 600
    docs = spark.createDataFrame([("a", "1", 2, "x"), ("a", "1", 2, "x"), ("b", "1", 1, "y")], "path string, doc_id string, enc_rank int, body string")
    assert [r.path for r in extract.best_edition(docs).collect()] == ["a"]


def test_editions_read_texts_once_more_than_their_narrow_columns(spark, tmp_path):
    path = str(tmp_path / "books")
    inputs.editions(spark, SF).write.parquet(path)
    plan = plan_of(extract.best_edition(extract.documents(spark.read.parquet(path), inputs.FORMAT)))
    # The losers come from the written narrow table, so the result scans the texts once.
    assert plan.count("content:string") == 1, plan


def test_profile_is_scanned_once_for_a_large_vocabulary(spark, profile):
    words = staged(wt.vocabulary(profile), "vocabulary")
    plan = plan_of(wt.with_vocabulary(wt.term_frequency(profile), words, broadcast_bytes=0))
    # What is left to do reads the rows written with the hot terms' entries, not the profile.
    assert "terms:array" not in plan, plan


def test_counts_against_brute_force(spark):
    made = random.Random(5)
    texts = [(i, " ".join(made.choice(["Cats", "cat", "s", "dog", "élan", "x_1"]) for _ in range(made.randrange(40)))) for i in range(50)]
    want = collections.Counter()
    for i, text in texts:
        for word in text.split():
            term = word.lower()
            want[i, term[:-1] if term.endswith("s") else term] += 1
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {(r.doc_id, r.term): r.n for r in pf.term_counts(pf.profiles(docs)).collect()} == want
    tidy = pf.tokens(docs).groupBy("doc_id", "term").count()
    assert {(r.doc_id, r.term): r["count"] for r in tidy.collect()} == want


def test_properties_of_weights(spark, profile):
    tf = wt.term_frequency(profile)
    assert tf.where("tf <= 0.4 or tf > 1").count() == 0
    assert tf.groupBy("doc_id").agg(F.max("tf").alias("m")).where("m <> 1").count() == 0
    words = wt.vocabulary(profile)
    assert words.where("idf < 0").count() == 0
    n_docs = profile.count()
    assert words.where((F.col("idf") == 0) != (F.col("df") == n_docs)).count() == 0
    total = profile.select(F.inline("terms")).agg(F.sum("n")).first()[0]
    assert pf.tokens(inputs.documents(spark, SF)).count() == total


def test_vectors(spark, profile):
    cells = staged(vec.hash_cells(profile, 50), "cells")
    assert cells.where("value < 0 or bucket < 0 or bucket >= 50").count() == 0
    want = collections.defaultdict(lambda: [0.0] * 50)
    for r in cells.collect():
        want[r.doc_id][r.bucket] = r.value
    vectors = vec.feature_vectors(cells, 50)
    assert dict(vectors.dtypes)["features"] == "vector"
    got = {r.doc_id: list(r.features.toArray()) for r in vectors.collect()}
    again = vec.feature_vectors(vec.hash_cells(profile, 50, by_document=True), 50)
    for r in again.collect():
        assert list(r.features.toArray()) == pytest.approx(got[r.doc_id])
    assert got == dict(want) and len(got) == 200
    assert vec.hash_cells(profile, 0).where("bucket <> 0").count() == 0


def test_double_hash_parts():
    for size in (10, 11, 10_000):
        first, second = vec.double_hash_sizes(size)
        assert first + second == size and first != second


def test_document_of_zeros_keeps_its_vector(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    vectors = vec.feature_vectors(vec.hash_cells(staged(pf.profiles(docs), "p"), 10), 10)
    assert [r.features.numNonzeros() for r in vectors.collect()] == [0, 0]


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    first = sampling.sample_with_replacement(df, 6, 0, "key").orderBy("draw").collect()
    assert first == sampling.sample_with_replacement(df.repartition(7), 6, 0, "key").orderBy("draw").collect()
    assert [r.draw for r in first] == list(range(6))
    assert len(sampling.sample_with_replacement(df.limit(1), 4, 0, "key").collect()) == 4
    assert sampling.sample_with_replacement(df.where("key < 0"), 4, 0, "key").count() == 0
    assert first != sampling.sample_with_replacement(df, 6, 1, "key").orderBy("draw").collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_local_operators_do_not_shuffle(spark, tmp_path):
    path = str(tmp_path / "docs")
    inputs.books(spark, SF).withColumn("doc_id", F.col("path")).write.parquet(path)
    stored = spark.read.parquet(path)
    profile = pf.profiles(stored, text="content", stop_words=inputs.STOP_WORDS)
    for df in (
        pf.term_counts(profile), pf.top_term(profile), wt.term_frequency(profile),
        extract.documents(stored, inputs.FORMAT), extract.line_documents(stored, inputs.FORMAT), extract.documents_unfiltered(stored, inputs.FORMAT),
    ):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan, plan
    # The text is split once, not again for a filter on the result.
    assert plan_of(pf.term_counts(profile)).count("split(") == 1
    assert plan_of(extract.documents(stored, inputs.FORMAT).select("doc_id")).count("split(content") == 1


def test_no_plan_has_a_cross_join_or_python(spark, profile):
    for df in (
        wt.top_terms(wt.tfidf(profile, broadcast_bytes=0), 5), vec.hash_cells(profile), index.postings(profile),
        extract.best_edition(extract.documents(inputs.editions(spark, SF), inputs.FORMAT)),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan, plan


def test_vectors_by_document_take_one_shuffle(spark, profile):
    plan = plan_of(vec.vector_rows(vec.hash_cells(profile, by_document=True)))
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_large_sides_are_sort_merged(spark, profile):
    words = staged(wt.vocabulary(profile), "vocabulary")
    docs = staged(extract.documents(inputs.editions(spark, SF), inputs.FORMAT), "editions")
    small = rows(extract.best_edition(docs), "path")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        split = wt.with_vocabulary(wt.term_frequency(profile), words, broadcast_bytes=0)
        plan = plan_of(split)
        # Rows of hot terms are ready, the rest is joined by shuffle.
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1, plan
        plain = wt.term_frequency(profile).join(words, "term")
        assert rows(split, "doc_id", "term", "tf", "idf") == rows(plain, "doc_id", "term", "tf", "idf")
        large = extract.best_edition(docs)
        assert "SortMergeJoin" in plan_of(large)
        assert rows(large, "path") == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_column_pruning_reaches_the_scan(spark, profile):
    assert "ReadSchema: struct<terms:array<struct<term:string>>>" in plan_of(wt.document_frequency(profile))
    assert "ReadSchema: struct<>" in plan_of(wt.document_count(profile))


def test_terms_of_several_parts_move_before_they_are_dealt_to_buckets(spark, profile):
    plan = plan_of(vec.hash_cells(profile, (10, 100, 1000)))
    # From the top down: one shuffle of terms by document, below the generator of the buckets.
    assert plan.count("Exchange hashpartitioning") == 1, plan
    generator = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(generator) == 1 and plan.index(generator[0]) < plan.index("Exchange hashpartitioning"), plan


def test_only_what_is_asked_for_is_written_beside_a_large_vocabulary(spark, profile):
    words = staged(wt.vocabulary(profile), "vocabulary")
    split = wt.with_vocabulary(wt.term_frequency(profile), words, broadcast_bytes=0, keep=["doc_id", "tf", "idf"])
    plain = wt.term_frequency(profile).join(words, "term")
    assert split.columns == ["doc_id", "tf", "idf"]
    assert rows(split, "doc_id", "tf", "idf") == rows(plain, "doc_id", "tf", "idf")
    marked = split.where("tf > 0").inputFiles()
    written = [spark.read.parquet(f) for f in marked if "/marked" in f]
    found = [r for df in written for r in df.where("_word is not null").limit(5).collect()]
    assert found and all(r.term is None and set(r.asDict()) == {"term", "doc_id", "tf", "_word"} for r in found)


def test_a_short_stop_list_given_as_a_table_does_not_move_the_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The cats of Er"), (1, "er"), (2, "the"), (3, None)], "doc_id bigint, text string")
    stop = spark.createDataFrame([("the",), ("Er",), ("of",), (None,), ("the",)], "word string")
    for ignore_case, terms in ((False, {(1, "cat", 1), (1, "er", 1)}), (True, {(1, "cat", 1)})):
        probed = pf.profiles(docs, stop_words=stop, ignore_case=ignore_case)
        plan = plan_of(probed)
        assert "Exchange" not in plan and "Join" not in plan, plan
        with monkeypatch.context() as m:
            m.setattr(pf, "PROBED_WORDS", 0)
            joined = pf.profiles(docs, stop_words=stop, ignore_case=ignore_case)
        assert "Join" in plan_of(joined)
        for found in (probed, joined):
            assert {tuple(r) for r in pf.term_counts(found).collect()} == terms
    with monkeypatch.context() as m:
        m.setattr(pf, "PROBED_BYTES", 3)
        assert "Join" in plan_of(pf.profiles(docs, stop_words=stop))


def test_run_lengths_index_the_words_once_a_step(spark):
    found = spark.sql("select array('a', 'b', 'b', '', 'a') as words, 1 as id union all select array(), 2 union all select null, 3")
    found = found.select("id", words.runs(F.sort_array("words")).alias("runs"))
    assert {r.id: None if r.runs is None else [tuple(x) for x in r.runs] for r in found.collect()} == {
        1: [("", 1), ("a", 2), ("b", 2)], 2: [], 3: []
    }
    # Terms and lengths of a document are put together by one expression, not a struct at a time.
    plan = plan_of(pf.profiles(inputs.documents(spark, SF)).select("terms"))
    assert plan.count("arrays_zip") == 1 and "struct(term" not in plan, plan
