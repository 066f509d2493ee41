"""One small case for each decision about an odd corner of the semantics."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from tomewright import DEFAULT_RULES, fixed_values as fv
from tomewright.functions import hashing, header, latin, words
from tomewright.operators import extract, profiles as pf, weights as wt
from tomewright.sources import files as src

FORMAT = header.BookFormat("MERIDIAN PRESS")
START = "*** START OF THIS MERIDIAN PRESS EBOOK T ***"
END = "*** END OF THIS MERIDIAN PRESS EBOOK T ***"


def book(number="42", charset="ASCII", body="Body text", language="English", start=START, end=END, form="EBook", title="T"):
    lines = [f"Title: {title}", f"Language: {language}"]
    lines += [f"Character set encoding: {charset}"] if charset else []
    lines += [f"[{form} #{number}]"] if number else []
    return "\n".join([*lines, start]) + "\n" + body + "\n" + end + "\nlicense"


documents = partial(extract.documents, book_format=FORMAT)
documents_unfiltered = partial(extract.documents_unfiltered, book_format=FORMAT)
line_documents = partial(extract.line_documents, book_format=FORMAT)


def files(spark, *contents):
    rows = [(f"f{i}", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "path string, content string")


def found(df):
    return {r.path: r for r in df.collect()}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def counted(spark, text, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return {r.term: r.n for r in pf.term_counts(pf.profiles(docs, **options)).collect()}


def test_missing_values_are_null_or_dropped(spark):
    no_id = files(spark, book(number=None))
    assert documents(no_id).count() == 0
    row = documents_unfiltered(files(spark, "plain text")).first()
    assert row.doc_id is None and row.body is None


def test_best_edition_is_by_rank_then_path_and_may_be_empty(spark):
    rows = spark.createDataFrame(
        [("c", "1", 1, "zzz"), ("b", "1", 3, ""), ("a", "1", 2, "aaa"), ("e", "2", 2, "e"), ("d", "2", 2, "d")],
        "path string, doc_id string, enc_rank int, body string",
    )
    assert {(r.doc_id, r.path) for r in extract.best_edition(rows).collect()} == {("1", "b"), ("2", "d")}
    assert {(r.doc_id, r.path) for r in extract.first_edition(rows).collect()} == {("1", "a"), ("2", "d")}


@pytest.mark.parametrize(
    "charset, rank", [("UTF-8", 3), ("utf-8", 3), ("ASCII", 2), ("ISO-8859-1", 1), ("Unicode", 1), (None, 1)]
)
def test_charset_rank_ignores_case(spark, charset, rank):
    assert documents(files(spark, book(charset=charset))).first().enc_rank == rank


def test_only_declared_other_charsets_are_transliterated(spark):
    docs = found(
        documents(
            files(spark, book(charset="ISO-8859-1", body="é"), book(charset="UTF-8", body="é"), book(charset=None, body="é"))
        )
    )
    assert [docs[f"f{i}"].body.strip() for i in range(3)] == ["e", "é", "é"]


def test_exactly_one_start_marker(spark):
    docs = documents(files(spark, book(start="none"), book(start=START + "\n" + START), book()))
    assert set(found(docs)) == {"f2"}


def test_several_end_markers_keep_the_footer(spark):
    docs = found(documents(files(spark, book(end=END + "\nx\n" + END), book(end="no end"), book())))
    assert docs["f0"].body.count("END OF") == 2
    assert docs["f1"].body.endswith("license")
    assert docs["f2"].body == "\nBody text\n"


def test_markers_are_case_sensitive_and_start_a_line(spark):
    docs = documents(files(spark, book(start=START.lower()), book(start=" " + START), book(start=START.replace("THIS", "THE"))))
    assert set(found(docs)) == {"f2"}


def test_id_forms_and_canonical_id(spark):
    docs = found(documents(files(spark, book(), book(form="Etext"), book(form="EBOOK"))))
    assert {p: d.doc_id for p, d in docs.items()} == {"f0": "42", "f1": "42"}
    assert value(spark, header.book_id(F.lit("x [EBook #7] [EBook #8]"))) == "#7"


def test_id_counts_only_in_the_header(spark):
    assert documents(files(spark, book(number=None, body="[EBook #1]"))).count() == 0
    assert documents_unfiltered(files(spark, book(number=None, body="[EBook #1]"))).first().doc_id == "1"


def test_nothing_after_the_header_drops_the_file(spark):
    assert documents(files(spark, "[EBook #1]\n" + START)).count() == 0


def test_default_rules(spark):
    docs = documents(
        files(
            spark,
            book(title="Human Genome Project, Chromosome 1"),
            book(charset="UTF-8", language="German"),
            book(charset="ASCII", language="German"),
            book(charset="UTF-8", language="English"),
            book(charset="UTF-8", language="German", body="Language: English"),
        ),
        rules=DEFAULT_RULES,
    )
    assert set(found(docs)) == {"f2", "f3"}


def test_rules_without_inclusions_keep(spark):
    rules = header.HeaderRules(exclude=(fv.GENOME_LINE,))
    docs = documents(files(spark, book(language="German"), book(title="Human Genome Project")), rules=rules)
    assert set(found(docs)) == {"f0"}


def test_unfiltered_keeps_the_footer_and_english_only(spark):
    rows = files(spark, book(), book(language="German"))
    assert found(documents_unfiltered(rows))["f1"].body.endswith("license")
    english = found(documents_unfiltered(rows, english_only=True))
    assert english["f0"].doc_id == "42" and english["f1"].doc_id is None and english["f1"].body is None


def test_line_body_starts_right_after_the_marker_in_order(spark):
    content = book(body="one\ntwo\nthree")
    assert line_documents(files(spark, content)).first().body == f"one two three {END} license"
    assert line_documents(files(spark, content), cut_footer=True).first().body == "one two three"


def test_line_mode_uses_first_header_and_first_id_anywhere(spark):
    content = START + "\na [EBook #1]\n" + START + "\nb [EBook #2]"
    row = line_documents(files(spark, content)).first()
    assert (row.doc_id, row.body) == ("1", f"a [EBook #1] {START} b [EBook #2]")


def test_line_mode_needs_body_lines_and_an_id(spark):
    rows = files(spark, "[EBook #1]\n" + START, "[EBook #1]\n" + START + "\n", START + "\nbody", "[EBook #1]\nbody")
    assert line_documents(rows).count() == 0


def test_line_ends(spark):
    def lines(text):
        return value(spark, src.text_lines(F.lit(text)))

    assert lines("a\r\nb\rc\nd\n") == ["a", "b", "c", "d"]
    assert lines("a\n\n") == ["a", ""]
    assert lines("") == []


def test_line_and_file_mode_agree_without_footer(spark):
    content = "[EBook #9]\n" + START + "\none two\nthree two\n"
    by_file = pf.profiles(documents(files(spark, content)), text="body").first()
    by_line = pf.profiles(line_documents(files(spark, content)), text="body").first()
    assert by_file == by_line


def test_stop_words_raw_and_singular(spark):
    assert counted(spark, "This this thi cats dog", stop_words=["this"]) == {"thi": 2, "cat": 1, "dog": 1}
    assert counted(spark, "This this thi cats dog", stop_words=["this"], ignore_case=True) == {"thi": 1, "cat": 1, "dog": 1}
    assert counted(spark, "er Er ER", stop_words=["Er"], ignore_case=True) == {}
    assert counted(spark, "this thi", stop_words=["thi"]) == {}
    assert counted(spark, "cats cat", stop_words=["cat"]) == {}
    assert counted(spark, "this cat", stop_words=["this"], stop_raw=False) == {"thi": 1, "cat": 1}


def test_lone_s_becomes_the_empty_term(spark):
    assert counted(spark, "s S a") == {"": 2, "a": 1}
    assert counted(spark, "s a", stop_words=[""]) == {"a": 1}
    assert counted(spark, "s a", min_term_len=1) == {"a": 1}


def test_crude_singular(spark):
    for word, term in {"Glass": "glas", "this": "thi", "s": "", "": "", "ODD": "odd", "ÄPFELS": "äpfel"}.items():
        assert value(spark, words.singular(F.lit(word))) == term


def test_unicode_and_ascii_words(spark):
    assert counted(spark, " élan_1, naïve!") == {"élan_1": 1, "naïve": 1}
    assert counted(spark, " naïve!", ascii_only=True) == {"": 2, "na": 1, "ve": 1}
    assert counted(spark, "", ascii_only=True) == {"": 1}
    assert counted(spark, " .,") == {}


def test_document_count_is_of_surviving_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "..."), (3, "a")], "doc_id bigint, text string")
    profile = pf.profiles(docs)
    assert wt.document_count(profile).first().n_docs == 2
    assert {r.term: r.idf for r in wt.vocabulary(profile).collect()} == {"a": 0.0, "b": 1.0}
    assert {r.term: r.idf for r in wt.vocabulary(profile, n_docs=8).collect()} == {"a": 2.0, "b": 3.0}


def test_top_term_ties_go_to_the_smallest(spark):
    docs = spark.createDataFrame([(1, "b b a a c")], "doc_id bigint, text string")
    assert tuple(pf.top_term(pf.profiles(docs)).first()) == (1, "a", 2)


def test_bucket_and_sign(spark):
    assert value(spark, hashing.bucket(F.lit("word"), 0)) == 0
    assert value(spark, hashing.bucket(F.lit("hello"), 10_000)) == int("5d41402a", 16) % 10_000
    assert [value(spark, hashing.sign(F.lit(w))) for w in ("", "a", "ab", "é")] == [-1, 1, -1, 1]


def test_transliteration(spark):
    text = "Straße Ærø «œuvre» ÅÄÖ ñ – “x” 日本 ½ ș Eſel e\u0301 € ‹Ŋ›"
    assert value(spark, latin.to_ascii(F.lit(text))) == "Strasse AEro <<oeuvre>> AAO n - \"x\" 日本 1/2 s Esel e EUR <NG>"
    assert value(spark, latin.to_ascii(F.lit("plain"))) == "plain"
    assert all(len(k) == 1 and v.isascii() for k, v in {**latin.LETTERS, **latin.EXPANSIONS}.items())
