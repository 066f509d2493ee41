"""Sources and pipelines on real files."""

import uuid

import pytest
from pyspark.sql import functions as F

from tests.test_pins import FORMAT, book
from tomewright import DEFAULT_RULES
from tomewright.operators import learn, profiles, subjects
from tomewright.plans import pipelines
from tomewright.sources import artifacts, files as src, metadata

RDF = """<?xml version="1.0" encoding="utf-8"?>
<rdf:RDF xmlns:rdf="urn:rdf" xmlns:dcterms="urn:dc" xmlns:pgterms="urn:pg">{}</rdf:RDF>"""
EBOOK = """<pgterms:ebook{about}>
  <dcterms:creator><pgterms:agent><pgterms:birthdate>{born}</pgterms:birthdate></pgterms:agent></dcterms:creator>
  {subjects}
</pgterms:ebook>"""
SUBJECT = '<dcterms:subject><rdf:Description rdf:nodeID="{}"><rdf:value>{}</rdf:value></rdf:Description></dcterms:subject>'


def ebook(number, *subjects, born="1800"):
    about = f' rdf:about="ebooks/{number}"' if number else ""
    return EBOOK.format(about=about, born=born, subjects="".join(SUBJECT.format(f"N{i}", s) for i, s in enumerate(subjects)))


@pytest.fixture()
def tree(tmp_path):
    def write(name, content, encoding="utf-8"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode(encoding))
        return str(tmp_path / "in")

    write.root = tmp_path
    return write


def test_recursive_and_flat_scan(spark, tree):
    tree("a/u.txt", "one")
    tree("a/.DS_Store", "hidden")
    root = tree("a/b/t.txt", "second")
    found = {r.file_name: r for r in src.book_files(spark, root).collect()}
    assert set(found) == {"u.txt", "t.txt"}
    assert (found["t.txt"].content, found["t.txt"].file_size) == ("second", 6)
    assert [r.file_name for r in src.book_files(spark, root + "/a", recursive=False).collect()] == ["u.txt"]
    assert [r.file_name for r in src.book_files(spark, root + "/*/*.txt", recursive=False).collect()] == ["u.txt"]
    assert src.count_files(spark, root).first().n_files == 2


def test_size_limit_is_strict(spark, tree):
    tree("three.txt", "123")
    root = tree("four.txt", "1234")
    assert [r.file_name for r in src.book_files(spark, root, smaller_than=4).collect()] == ["three.txt"]


def test_declared_charset_decides_decoding(spark, tree):
    content = book(charset="ISO-8859-1", body="café\r\nfür")
    tree("latin.txt", content, "latin-1")
    tree("utf.txt", book(charset="UTF-8", body="café"))
    root = tree("none.txt", book(charset=None, body="café"))
    found = {r.file_name: r.content for r in src.book_files_by_charset(spark, root).collect()}
    assert found["latin.txt"] == content
    assert "café" in found["utf.txt"] and "café" in found["none.txt"]
    docs = spark.createDataFrame([("p", found["latin.txt"])], "path string, content string")
    assert [r.line for r in src.lines_of(docs).collect()][5:7] == ["café", "für"]
    small = src.book_files_by_charset(spark, root, smaller_than=1)
    assert small.count() == 0


def test_stop_list_file(spark, tree):
    root = tree("stop.txt", "the,of\nand, the,\nle")
    assert {r.word for r in src.stop_words(spark, root + "/stop.txt").collect()} == {"the", "of", "and", "", "le"}


def test_metadata_files(spark, tree):
    tree("x/pg1.rdf", RDF.format(ebook(1, "Whales", "Sea &amp; land")))
    tree("x/.DS_Store", "not xml")
    tree("pg2.rdf", RDF.format(ebook(2) + ebook(3, "Whales", born="n.d.")))
    root = tree("pg4.rdf", RDF.format(ebook(None, "Lost")))
    found = {(r.file_name, r.ebook_id): r for r in metadata.metadata_files(spark, root).collect()}
    assert set(found) == {("pg1.rdf", "1"), ("pg2.rdf", "2"), ("pg2.rdf", "3"), ("pg4.rdf", None)}
    assert [tuple(s) for s in found["pg1.rdf", "1"].subjects] == [("N0", "Whales"), ("N1", "Sea & land")]
    assert found["pg2.rdf", "2"].subjects == [] and found["pg2.rdf", "3"].birth_year is None
    assert found["pg1.rdf", "1"].birth_year == 1800
    out = str(tree.root / "meta")
    stored = pipelines.book_metadata(spark, root, out)
    assert stored.count() == 4 and pipelines.book_metadata(spark, "/nowhere", out).count() == 4
    top = subjects.top_subjects(stored, 1).collect()
    assert [tuple(r) for r in top] == [("Whales", 2)]


def test_last_description_that_says_something(spark):
    xml = RDF.format(
        '<pgterms:ebook rdf:about="ebooks/5"><dcterms:subject><rdf:Description rdf:nodeID="A"><rdf:value>x</rdf:value>'
        '</rdf:Description><rdf:Description rdf:nodeID="B"/></dcterms:subject></pgterms:ebook>'
    )
    rows = spark.createDataFrame([("f", xml)], "file_name string, xml string")
    record = metadata.metadata_of(rows).first()
    assert [tuple(s) for s in record.subjects] == [("B", "x")]
    bare = spark.createDataFrame([("f", RDF.format("<pgterms:ebook><dcterms:creator/></pgterms:ebook>"))], "file_name string, xml string")
    assert [(r.ebook_id, r.subjects) for r in metadata.metadata_of(bare).collect()] == [(None, [])]
    blank = spark.createDataFrame([("f", RDF.format(""))], "file_name string, xml string")
    assert metadata.metadata_of(blank).count() == 0


def test_read_or_build_builds_once_and_again_after_an_interrupted_write(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "artifact")
    for _ in range(2):
        assert artifacts.read_or_build(spark, path, build).count() == 3
    assert len(calls) == 1
    partial = tmp_path / "partial"
    partial.mkdir()
    (partial / "part-0.parquet").write_bytes(b"half")
    assert artifacts.read_or_build(spark, str(partial), build).count() == 3
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    (foreign / "notes.txt").write_text("mine")
    with pytest.raises(FileExistsError):
        artifacts.read_or_build(spark, str(foreign), build)
    assert (foreign / "notes.txt").read_text() == "mine" and len(calls) == 2
    with pytest.raises(Exception):
        artifacts.store(spark.range(1), path)
    with artifacts.kept(spark.range(2)) as cached:
        assert cached.count() == 2 and cached.is_cached
    assert not cached.is_cached


def test_temporary_tables_are_deleted_after_use(spark, tmp_path):
    made = []

    def build():
        made.append(artifacts.stage(spark.range(5), "numbers"))
        return artifacts.load(spark, made[0])

    before = artifacts.stage(spark.range(1), "kept")
    assert artifacts.read_or_build(spark, str(tmp_path / "out"), build).count() == 5
    assert not artifacts.is_complete(spark, made[0]) and artifacts.is_complete(spark, before)


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert artifacts.shared_folder(spark) == configured
    assert artifacts.new_path(spark, "x") != artifacts.new_path(spark, "x")


def jobs_of(spark, action):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    action()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_of_line_mode_do_not_grow_with_the_files(spark, tree):
    def run(n, name):
        for i in range(n):
            root = tree(f"{name}/f{i}.txt", book(number=i, body=f"w{i}"))
        folder = f"{root}/{name}"
        return jobs_of(
            spark,
            lambda: pipelines.line_book_profiles(
                src.book_files(spark, folder, smaller_than=10_000), FORMAT, DEFAULT_RULES
            ).collect(),
        )

    # Adaptive execution may add a job or two for sides that are not empty.
    assert run(100, "hundred") <= run(1, "one") + 2


def test_book_vectors_end_to_end(spark, tree):
    tree("books/a/1.txt", book(number=1, charset="ISO-8859-1", body="whale ships élan"))
    tree("books/a/1-8.txt", book(number=1, charset="UTF-8", body="whale ships élan élan"))
    tree("books/2.txt", book(number=2, body="the whale"))
    tree("books/3.txt", "no marker")
    root = tree("stop.txt", "the")
    out = str(tree.root / "vectors")
    made = pipelines.book_vectors(spark, root + "/books", out, FORMAT, root + "/stop.txt", size=64)
    got = {r.doc_id: r.features for r in made.collect()}
    assert set(got) == {"1", "2"} and got["1"].size == 64
    # "whale" is in both books, so book 2 has no weight left; tf of "ship" is .4 + .6 / 2.
    assert got["2"].numNonzeros() == 0
    assert sorted(round(x, 6) for x in got["1"].values) == [0.7, 1.0]
    assert dict(pipelines.book_vectors(spark, "/nowhere", out, FORMAT).dtypes)["features"] == "vector"
    lines = pipelines.book_vectors(
        spark, root + "/books", out + "-lines", FORMAT, size=(31, 33), by_line=True, rules=DEFAULT_RULES, n_docs=10
    )
    assert {r.doc_id for r in lines.collect()} == {"1", "2"} and lines.first().features.size == 64


def test_stored_books_resume_by_folder(spark, tree):
    tree("b/1.txt", book(number=1))
    root = tree("a/2.txt", book(number=2, body="longer text"))
    folders, out = [f"{root}/a", f"{root}/b"], str(tree.root / "stored")
    assert pipelines.stored_books(spark, folders[:1], out).count() == 1
    stored = pipelines.stored_books(spark, folders, out)
    assert {r.file_name for r in stored.collect()} == {"1.txt", "2.txt"}
    largest = stored.agg({"file_size": "max"}).first()[0]
    for limit, ids in ((None, {"1", "2"}), (largest, {"1"})):
        vectors = pipelines.book_vectors(spark, stored, str(tree.root / f"vectors-{limit}"), FORMAT, smaller_than=limit)
        assert {r.doc_id for r in vectors.collect()} == ids


def test_stored_books_returns_the_folders_asked_for(spark, tree):
    tree("b/1.txt", book(number=1))
    root = tree("a/2.txt", book(number=2))
    a, b, out = f"{root}/a", f"{root}/b", str(tree.root / "stored")

    def names(folders):
        return sorted(r.file_name for r in pipelines.stored_books(spark, folders, out).collect())

    assert names([a]) == ["2.txt"] and names([b]) == ["1.txt"] and names([b, a]) == ["1.txt", "2.txt"]
    assert names([a, a + "/"]) == ["2.txt"]
    with pytest.raises(ValueError):
        names([root, a])


def test_a_size_limit_that_no_file_reaches_changes_nothing(spark, tree):
    tree("1.txt", book(number=1, body="whale"))
    root = tree("2.txt", book(number=2, body="ship ISO", charset="ISO-8859-1"))

    def vectors(name, limit):
        found = pipelines.book_vectors(spark, root, str(tree.root / name), FORMAT, smaller_than=limit)
        return {r.doc_id: r.features for r in found.collect()}

    assert vectors("without", None) == vectors("with", 1 << 30)


@pytest.mark.parametrize(
    "declared, codec, body",
    [
        ("ISO-8859-1", "latin-1", "café ¤"), ("ISO Latin-1", "latin-1", "café"), ("ISO-8859-2", "iso8859-2", "žluťoučký"),
        ("ISO-8859-15", "iso8859-15", "€ œuvre"), ("Windows-1252", "cp1252", "“x” – €"), ("UTF-8", "utf-8", "日本"),
    ],
)
def test_known_charsets(spark, tree, declared, codec, body):
    root = tree("f.txt", book(charset=declared, body=body), codec)
    assert body in src.book_files_by_charset(spark, root).first().content


def test_staged_tables_are_marked_for_deletion(spark):
    path = artifacts.stage(spark.range(2), "numbers")
    folder, system = artifacts._folder(spark, path)
    # True only if the path was marked before.
    assert system.cancelDeleteOnExit(folder) and system.deleteOnExit(folder)


def test_size_limit_reaches_the_scan(spark, tree):
    root = tree("three.txt", "123")
    files = src.book_files(spark, root).where("file_size < 3")
    assert files.rdd.getNumPartitions() == 0


def test_an_edition_without_terms_still_wins(spark):
    rows = [("a", book(number=1, charset="UTF-8", body="...")), ("b", book(number=1, charset="ASCII", body="words"))]
    files = spark.createDataFrame(rows, "path string, content string")
    assert pipelines.book_profiles(files, FORMAT).count() == 0


def test_file_index_merges_equal_names(spark, tree):
    tree("x/f.txt", "cats dog")
    tree("y/f.txt", "cat")
    root = tree("y/g.txt", "cat the")
    index = pipelines.file_index(src.book_files(spark, root), 10, ["the"])
    got = {r.term: (r.df, [tuple(p) for p in r.postings]) for r in index.collect()}
    assert got == {"cat": (2, [("f.txt", 2), ("g.txt", 1)]), "dog": (1, [("f.txt", 1)])}


def test_file_index_moves_only_the_counts_of_shared_names(spark, monkeypatch):
    rows = [("x/f", "f", "cats dog"), ("y/f", "f", "cat"), ("y/g", "g", "cat"), ("z", None, "dog"), ("z", None, "dogs"), ("e", "h", None)]
    files = spark.createDataFrame(rows, "path string, file_name string, content string")
    summed = []

    def merged(profile, key):
        summed.append(sorted((r.file_name or "", r.terms) for r in profile.collect()))
        return profiles.merged(profile, key)

    monkeypatch.setattr(pipelines, "merged", merged)
    found = pipelines.file_index(files, 10).select("term", "df", F.inline("postings")).collect()
    assert sorted((r.term, r.df, r.file_name or "", r.n) for r in found) == [
        ("cat", 2, "f", 2), ("cat", 2, "g", 1), ("dog", 2, "", 2), ("dog", 2, "f", 1)
    ]
    assert [name for name, _ in summed[0]] == ["", "", "f", "f"]


def test_learning_finds_a_clear_subject(spark):
    from pyspark.ml.linalg import Vectors

    made = [(str(i), Vectors.sparse(4, [i % 2], [1.0])) for i in range(80)]
    vectors = spark.createDataFrame(made, ["doc_id", "features"])
    records = spark.createDataFrame(
        [(str(i), [("", "even" if i % 2 == 0 else "odd")], 1800 + 50 * (i % 2)) for i in range(80)],
        "ebook_id string, subjects array<struct<subject_id:string,subject_txt:string>>, birth_year int",
    )
    rows, names = learn.labelled(vectors, records, k=2, folds=2)
    assert names == ["even", "odd"]
    errors = learn.subject_errors(
        rows, names, [learn.naive_bayes(), learn.decision_tree((1, 2)), learn.logistic_regression((0.01,))], folds=2
    ).collect()
    assert len(errors) == 2 * (1 + 2 + 1)
    assert all(r.training_error == 0 and r.testing_error == 0 for r in errors)
    assert {r.method for r in errors if r.chosen} == {"naive_bayes", "decision_tree", "logistic_regression"}
    lasso = learn.birth_year_regression(vectors, records, penalties=(0.01,)).first()
    assert lasso.testing_rmse < 1 and lasso.n_training + lasso.n_testing == 80
    assert sum(r.label for r in subjects.subject_labels(vectors.select("doc_id"), records, 2).collect()) == 80


def test_files_of_each_row_lie_as_sparks_writer_lays_them(spark, tmp_path):
    rows = [("7", "one\ntwo"), ("7", "again"), (None, "no name"), ("", "empty name"), ("8", None), ("a/b%", "é"), ("9", "")]
    df = spark.createDataFrame(rows, "name string, content string").coalesce(1)
    df = df.unionAll(df.where("name = '9'"))
    df.write.partitionBy("name").text(str(tmp_path / "spark"))
    src.write_each(df, "name", "content", str(tmp_path / "own"))

    def found(top):
        return sorted((f.parent.name, f.read_bytes()) for f in (tmp_path / top).rglob("part-*"))

    assert found("own") == found("spark") and len(found("own")) == 5
    assert (tmp_path / "own" / "_SUCCESS").exists()
