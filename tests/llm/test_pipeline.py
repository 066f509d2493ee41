"""The pipeline's stages, each against a plain computation on the same input."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import corner
from tests.llm.test_free_forms import brute_classes
from tomewright.llm import decontaminate, lines, mixing, near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns_stay_those_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert [name for name, _ in pipeline.STAGES] == list(stages)
    assert all(out.dtypes == columns for name, (_, out) in list(stages.items())[:-1])


def test_clean_documents_pass_language_id(stages):
    before, after = stages["language_id"]
    lost = {r.doc_id: r.text for r in before.join(after, "doc_id", "left_anti").collect()}
    assert len(lost) <= 0.01 * before.count()


def test_line_dedup_changes_texts_only(stages):
    before, after = stages["line_dedup"]
    keys, holders = {}, {}
    rows = {r.doc_id: r.text.split("\n") for r in before.collect()}

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(lines.WHITE))

    for d, ls in rows.items():
        for x in map(key, ls):
            if len(x) >= lines.MIN_CHARS:
                holders.setdefault(x, set()).add(d)
    keys = {x: max(ds) for x, ds in holders.items() if len(ds) >= lines.MIN_DOCS}
    want = {d: "\n".join(x for x in ls if d >= keys.get(key(x), d)) for d, ls in rows.items()}
    got = {r.doc_id: r for r in after.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_near_dedup_keeps_one_of_each_class(stages):
    before, after = stages["near_dedup"]
    idf = near.inverse_frequency(before.select("text"))
    classes = {c.split(", ")[1] for c in brute_classes(corner.plain(before), idf)}
    assert {str(r.doc_id) for r in after.collect()} == classes


def test_decontamination_drops_exactly_contaminated_documents(spark, stages):
    before, after = stages["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.plain_words(r.text.encode())
        windows |= {tuple(w[s : s + 10]) for s in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)}
    sizes = {len(w) for w in windows if w}
    clean = set()
    for d, text in corner.plain(before):
        w = decontaminate.plain_words(text.encode())
        if not any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1)):
            clean.add(d)
    assert {r.doc_id for r in after.collect()} == clean


def test_mix_meets_targets(stages):
    before, after = stages["source_mixing"]
    sums = after.join(before.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("n"), F.max("target").alias("t"), F.sum("size").alias("s")
    ).collect()
    want = mixing.targets({r.source: r.s for r in sums})
    # Few documents are left of a source here, so their sums cannot meet every target.
    assert all(abs(r.t - want[r.source]) < 1e-6 and r.n <= r.t + 1 and r.n >= 0.9 * r.t for r in sums)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["source_mixing"][1].collect()))


def test_stages_take_corner_rows(spark):
    docs = corner.documents(spark)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.count() <= 19
        if name != "source_mixing":
            assert out.dtypes == docs.dtypes, name
    assert pipeline.dedup_lines(spark, docs, SF).where("text is null").count() == 2


def test_near_stage_goes_by_row(spark):
    """Copies go also where ids repeat or are missing, and one row of each class stays."""
    a, b = corner.prose(1, 80), corner.prose(2, 80)
    rows = [(9, a), (9, a), (9, b), (5, b), (None, a), (None, b), (None, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text or "", r.source) for r in pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted([(5, b, "s3"), (7, "", "s7"), (9, a, "s0")])


def test_language_stage_rejects_junk_and_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = spark.createDataFrame([(10**9, "12345 %%% 678", None, "x", 13), (10**9 + 1, None, None, "x", 0)], docs.schema)
    kept = pipeline.identify_languages(spark, docs.unionByName(junk), "/root/testdata/sf0.01")
    assert kept.where("doc_id >= 1000000000").count() == 0 and kept.count() >= 0.99 * docs.count()
