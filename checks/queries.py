"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from tomewright import fixed_values as fv
from tomewright.functions import header as h
from tomewright.functions.latin import to_ascii
from tomewright.operators import bayes, extract, learn, linear, sampling, subjects, trees
from tomewright.operators import examples as ex
from tomewright.operators import postings as index
from tomewright.operators import profiles as pf
from tomewright.operators import vectors as vec
from tomewright.operators import weights as wt
from tomewright.plans import pipelines
from tomewright.sources import artifacts, files, metadata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Small, so that the queries meet terms of several blocks.
BLOCK = 100


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def profile(spark: SparkSession, sf: str, **options) -> DataFrame:
    return pf.profiles(inputs.documents(spark, sf), **options)


def staged_profile(spark: SparkSession, sf: str, **options) -> DataFrame:
    return artifacts.staged(profile(spark, sf, **options), "profiles")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def listing(terms: str, first: str, second: str):
    return F.md5(
        F.array_join(F.transform(terms, lambda t: F.concat_ws(":", t[first], t[second])), " ").cast("binary")
    ).alias("listing")


# --- words and counts ---------------------------------------------------------


@query
def word_tokens(spark, sf):
    return pf.tokens(inputs.documents(spark, sf))


@query
def word_tokens_ascii(spark, sf):
    return pf.tokens(inputs.documents(spark, sf), ascii_only=True)


@query
def term_counts(spark, sf):
    return pf.term_counts(profile(spark, sf))


@query
def term_counts_ascii(spark, sf):
    return pf.term_counts(profile(spark, sf, ascii_only=True))


@query
def stop_filtered_counts(spark, sf):
    return pf.term_counts(profile(spark, sf, stop_words=inputs.STOP_WORDS))


@query
def stop_filtered_ignore_case(spark, sf):
    return pf.term_counts(profile(spark, sf, stop_words=inputs.STOP_WORDS, ignore_case=True))


@query
def stop_filtered_simple(spark, sf):
    return pf.term_counts(profile(spark, sf, ascii_only=True, stop_words=inputs.STOP_WORDS, stop_raw=False))


def _listed_words(spark, sf):
    texts = inputs.table(spark, sf, "benchmark").select(F.col("item_id").alias("path"), F.col("text").alias("content"))
    return files.stop_words_of(files.lines_of(texts))


@query
def stop_list_words(spark, sf):
    return _listed_words(spark, sf)


@query
def stop_filtered_long_list(spark, sf):
    """A list given as a table is joined."""
    return pf.term_counts(profile(spark, sf, stop_words=_listed_words(spark, sf)))


@query
def stop_filtered_list_ignore_case(spark, sf):
    return pf.term_counts(profile(spark, sf, stop_words=_listed_words(spark, sf), ignore_case=True))


@query
def stop_filtered_file(spark, sf):
    """The same list written as a text file and read back by the stop-list scan."""
    path = artifacts.temporary_path(spark, "stop_list")
    inputs.table(spark, sf, "benchmark").select("text").write.text(path)
    return pf.term_counts(profile(spark, sf, stop_words=files.stop_words(spark, path)))


@query
def min_term_length(spark, sf):
    return pf.term_counts(profile(spark, sf, min_term_len=3))


@query
def transliterated_counts(spark, sf):
    return pf.term_counts(profile(spark, sf, transliterate=True))


@query
def nested_counts(spark, sf):
    return profile(spark, sf).select(
        "doc_id", "max_n", F.size("terms").cast("bigint").alias("n_terms"), listing("terms", "term", "n")
    )


@query
def max_term_count(spark, sf):
    return pf.max_counts(profile(spark, sf))


@query
def top_term(spark, sf):
    return pf.top_term(profile(spark, sf))


def _by_source(spark, sf):
    docs = inputs.texts(spark, sf, "source", "text")
    return pf.merged(pf.profiles(docs, carry=["source"]), "source")


@query
def source_counts(spark, sf):
    return _by_source(spark, sf)


@query
def source_top_term(spark, sf):
    return pf.max_merged(_by_source(spark, sf), "source")


@query
def kept_profile_counts(spark, sf):
    """Three results of one profile that is cached for them and released."""
    with artifacts.kept(profile(spark, sf)) as counted:
        found = [
            ("documents", counted.count()), ("terms", wt.document_frequency(counted).count()),
            ("occurrences", pf.term_counts(counted).agg(F.sum("n")).first()[0]),
        ]
    return spark.createDataFrame(found, "what string, n bigint")


# --- weights -------------------------------------------------------------------


@query
def document_count(spark, sf):
    return wt.document_count(profile(spark, sf))


@query
def document_frequency(spark, sf):
    return wt.document_frequency(profile(spark, sf))


@query
def idf(spark, sf):
    return rounded(wt.vocabulary(staged_profile(spark, sf)), "idf")


@query
def idf_given_total(spark, sf):
    return rounded(wt.vocabulary(profile(spark, sf), n_docs=1_000_000), "idf")


@query
def normalised_tf(spark, sf):
    return rounded(wt.term_frequency(profile(spark, sf)), "tf")


@query
def tf_by_word(spark, sf):
    by_word = wt.term_frequency(profile(spark, sf)).groupBy("term")
    return rounded(by_word.agg(F.count("*").alias("n_docs"), F.sum("tf").alias("tf_sum")), "tf_sum")


@query
def tfidf(spark, sf):
    return rounded(wt.tfidf(staged_profile(spark, sf)), "tfidf").select("doc_id", "term", "tfidf")


@query
def tfidf_large_vocabulary(spark, sf):
    """The join for a vocabulary too large to broadcast; forced here by a limit of no bytes."""
    weighed = wt.tfidf(staged_profile(spark, sf), broadcast_bytes=0)
    return rounded(weighed, "tfidf").select("doc_id", "term", "tfidf")


@query
def tfidf_top_terms(spark, sf):
    best = wt.top_terms(wt.tfidf(staged_profile(spark, sf)), 5)
    return rounded(best, "tfidf").select("doc_id", "term", "rank", "tfidf")


@query
def postings(spark, sf):
    return index.postings(staged_profile(spark, sf))


@query
def posting_lists(spark, sf):
    return _listings(index.posting_lists(index.postings(staged_profile(spark, sf)), BLOCK), "doc_id")


def _listings(lists: DataFrame, key: str) -> DataFrame:
    n = F.size("postings").cast("bigint").alias("n_postings")
    return lists.select("term", "df", "block", "blocks", n, listing("postings", key, "n"))


@query
def file_index(spark, sf):
    return _listings(pipelines.file_index(inputs.books(spark, sf), BLOCK), "file_name")


# --- vectors -------------------------------------------------------------------


@query
def hash_cells(spark, sf):
    return rounded(vec.hash_cells(staged_profile(spark, sf)), "value")


@query
def double_hash_cells(spark, sf):
    return rounded(vec.hash_cells(staged_profile(spark, sf), vec.double_hash_sizes()), "value")


@query
def hash_cells_large_vocabulary(spark, sf):
    return rounded(vec.hash_cells(staged_profile(spark, sf), broadcast_bytes=0), "value")


SIZES = (100, 1000, fv.VECTOR_SIZE)


@query
def vector_size_cells(spark, sf):
    """All sizes are hashed in one pass, as parts of one vector, and told apart again."""
    cells = vec.hash_cells(staged_profile(spark, sf), SIZES)
    starts = [sum(SIZES[:i]) for i in range(len(SIZES))]
    size, start = F.lit(SIZES[0]), F.lit(0)
    for s, at in zip(SIZES[1:], starts[1:], strict=True):
        inside = F.col("bucket") >= at
        size, start = F.when(inside, s).otherwise(size), F.when(inside, at).otherwise(start)
    return rounded(cells.select(size.alias("size"), "doc_id", (F.col("bucket") - start).alias("bucket"), "value"), "value")


@query
def feature_vectors(spark, sf):
    cells = rounded(vec.hash_cells(staged_profile(spark, sf), by_document=True), "value")
    rows = vec.vector_rows(cells).select("doc_id", "features.*")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "doc_id", F.col("size").cast("bigint").alias("size"), F.size("indices").cast("bigint").alias("n_filled"),
        F.round(total, 6).alias("total"),
    )


# --- documents from book files ---------------------------------------------------


def _out(docs: DataFrame, *more: str) -> DataFrame:
    body = F.col("body")
    return docs.select(
        "path", "doc_id", F.md5(body.cast("binary")).alias("body_md5"), F.length(body).cast("bigint").alias("n_chars"), *more
    )


@query
def header_fields(spark, sf):
    books = extract.split_header(inputs.books(spark, sf), inputs.FORMAT)
    head = F.col("header")
    declared = h.charset(head)
    return books.select(
        "path", h.book_id(head).alias("book_id"), declared.alias("charset"), h.charset_rank(declared).alias("enc_rank"),
        *[h.language_is(head, name).alias(name.lower()) for name in ("English", "German", "French", "Esperanto")],
        F.md5(head.cast("binary")).alias("header_md5"),
        F.md5(h.without_footer(F.col("body"), inputs.FORMAT).cast("binary")).alias("body_md5"),
    )


@query
def book_documents(spark, sf):
    return _out(extract.documents(inputs.books(spark, sf), inputs.FORMAT), "enc_rank")


@query
def book_documents_by_rules(spark, sf):
    return _out(extract.documents(inputs.books(spark, sf), inputs.FORMAT, h.DEFAULT_RULES), "enc_rank")


@query
def book_documents_two_rules(spark, sf):
    rules = h.HeaderRules(include=(h.language_line("German"), h.language_line("French")))
    return _out(extract.documents(inputs.books(spark, sf), inputs.FORMAT, rules), "enc_rank")


@query
def book_documents_unfiltered(spark, sf):
    return _out(extract.documents_unfiltered(inputs.books(spark, sf), inputs.FORMAT))


@query
def book_documents_english(spark, sf):
    return _out(extract.documents_unfiltered(inputs.books(spark, sf), inputs.FORMAT, english_only=True))


@query
def transliterated_texts(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", to_ascii(F.col("text")).alias("text"))


@query
def best_edition(spark, sf):
    return _out(extract.best_edition(extract.documents(inputs.editions(spark, sf), inputs.FORMAT)), "enc_rank")


@query
def first_edition(spark, sf):
    return _out(extract.first_edition(extract.documents(inputs.editions(spark, sf), inputs.FORMAT)), "enc_rank")


@query
def edition_profiles(spark, sf):
    return pf.term_counts(pipelines.book_profiles(inputs.editions(spark, sf), inputs.FORMAT))


def _full_options(spark) -> dict:
    words = spark.createDataFrame([(word,) for word in inputs.STOP_WORDS], "word string")
    return {"rules": h.DEFAULT_RULES, "stop_words": words, "transliterate": True}


@query
def edition_profiles_all_options(spark, sf):
    """Rules, stop list and transliteration together."""
    return pf.term_counts(pipelines.book_profiles(inputs.editions(spark, sf), inputs.FORMAT, **_full_options(spark)))


def _vector_cells(spark, sf, **options) -> DataFrame:
    """Vectors of the whole pipeline, with a stop list read from a file."""
    stop, out = artifacts.temporary_path(spark, "stop_list"), artifacts.temporary_path(spark, "vectors")
    spark.createDataFrame([(",".join(inputs.STOP_WORDS),)], "line string").write.text(stop)
    pipelines.book_vectors(
        spark, inputs.editions(spark, sf), out, inputs.FORMAT, stop, h.DEFAULT_RULES, transliterate=True, **options
    )
    zipped = F.inline(F.arrays_zip(F.col("features.indices").alias("bucket"), F.col("features.values").alias("value")))
    return rounded(spark.read.parquet(out).select("doc_id", zipped), "value").where("value <> 0")


@query
def book_vectors(spark, sf):
    return _vector_cells(spark, sf)


@query
def line_book_vectors(spark, sf):
    return _vector_cells(spark, sf, by_line=True)


# --- documents by lines ----------------------------------------------------------


@query
def book_lines(spark, sf):
    return files.lines_of(inputs.books(spark, sf))


@query
def probed_lines(spark, sf):
    return files.probe_lines(files.lines_of(inputs.books(spark, sf)), fv.BOOK_ID).select("path", "line_no", "hit")


@query
def line_documents(spark, sf):
    return _out(extract.line_documents(inputs.books(spark, sf), inputs.FORMAT))


@query
def line_documents_by_rules(spark, sf):
    return _out(extract.line_documents(inputs.books(spark, sf), inputs.FORMAT, h.DEFAULT_RULES))


@query
def line_documents_cut(spark, sf):
    return _out(extract.line_documents(inputs.books(spark, sf), inputs.FORMAT, cut_footer=True))


@query
def line_edition_profiles(spark, sf):
    return pf.term_counts(pipelines.line_book_profiles(inputs.editions(spark, sf), inputs.FORMAT))


# --- metadata --------------------------------------------------------------------


def _metadata(spark, sf):
    return metadata.metadata_of(inputs.rdf_documents(spark, sf))


def _summary(records: DataFrame, *first: str) -> DataFrame:
    return records.select(*first, "ebook_id", "birth_year", F.size("subjects").cast("bigint").alias("n_subjects"))


def _subject_rows(records: DataFrame, *first: str) -> DataFrame:
    rows = records.select(*first, F.posexplode("subjects").alias("place", "subject"))
    return rows.select(*first, "place", "subject.*")


@query
def metadata_records(spark, sf):
    return _summary(_metadata(spark, sf), "file_name")


@query
def metadata_subjects(spark, sf):
    return _subject_rows(_metadata(spark, sf), "file_name", "ebook_id")


@query
def metadata_with_blanks(spark, sf):
    return _subject_rows(metadata.with_blanks(_metadata(spark, sf)), "ebook_id")


@query
def top_subjects(spark, sf):
    return subjects.top_subjects(_metadata(spark, sf))


@query
def subject_labels(spark, sf):
    docs = inputs.documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"))
    return subjects.subject_labels(docs, artifacts.staged(_metadata(spark, sf), "metadata"))


# --- files -----------------------------------------------------------------------


def _write_each(df: DataFrame, content: str) -> str:
    """One text file per document, in a folder of its own."""
    path = artifacts.temporary_path(df.sparkSession, "files")
    files.write_each(df, "name", content, path)
    return path


_WRITTEN: dict[tuple[str, str], str] = {}


def _written_books(spark, sf):
    """Files of all books; written once per application."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _WRITTEN:
        name = F.regexp_extract("file_name", "^([0-9]+)", 1).alias("name")
        _WRITTEN[place] = _write_each(inputs.books(spark, sf).select(name, "content"), "content")
    return _WRITTEN[place]


def _name_in(path: str):
    return F.regexp_extract(path, "name=([0-9]+)", 1).alias("doc_id")


def _scan_out(found: DataFrame) -> DataFrame:
    return found.select(_name_in("path"), "file_size", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query
def scanned_books(spark, sf):
    return _scan_out(files.book_files(spark, _written_books(spark, sf)))


@query
def flat_scanned_books(spark, sf):
    return _scan_out(files.book_files(spark, _written_books(spark, sf) + "/name=*", recursive=False))


@query
def stored_books(spark, sf):
    """All books in two folders, stored by three calls, of which the last asks for both."""
    books = inputs.books(spark, sf)
    plain = F.replace("content", F.lit("encoding: ISO-8859-1"), F.lit("encoding: US-ASCII")).alias("content")
    number = F.regexp_extract("file_name", "^([0-9]+)", 1)
    folders = [
        _write_each(books.where(F.pmod(number.cast("bigint"), F.lit(2)) == part).select(number.alias("name"), plain), "content")
        for part in (0, 1)
    ]
    out = artifacts.temporary_path(spark, "stored")
    pipelines.stored_books(spark, folders[:1], out)
    pipelines.stored_books(spark, folders[1:], out)
    return _scan_out(pipelines.stored_books(spark, folders[::-1], out))


@query
def small_scanned_books(spark, sf):
    return _scan_out(files.book_files(spark, _written_books(spark, sf), smaller_than=2000))


@query
def decoded_books(spark, sf):
    """Bytes of books in the character set that each declares, decoded again."""
    books = inputs.books(spark, sf)
    latin = F.regexp_replace("content", r"[^\x00-\xFF]", "?")
    declared = F.contains("content", F.lit("Character set encoding: ISO-8859-1"))
    stored = F.when(declared, F.encode(latin, "ISO-8859-1")).otherwise(F.encode("content", "UTF-8"))
    text = files.decoded(F.col("stored"))
    return books.select("path", stored.alias("stored")).select("path", F.md5(text.cast("binary")).alias("content_md5"))


@query
def counted_files(spark, sf):
    return files.count_files(spark, _written_books(spark, sf) + "/name=*")


def written_metadata(spark, sf):
    """RDF files of all documents; written once per application."""
    place = (spark.sparkContext.applicationId, sf + "/rdf")
    if place not in _WRITTEN:
        rdf = inputs.rdf_documents(spark, sf).select(F.col("file_name").alias("name"), "xml")
        _WRITTEN[place] = _write_each(rdf, "xml")
    return _WRITTEN[place]


@query
def scanned_metadata(spark, sf):
    return _summary(metadata.metadata_files(spark, written_metadata(spark, sf)))


@query
def stored_folder_metadata(spark, sf):
    """Records of two folders of RDF files, listed and stored one after the other, and the number of their files."""
    rdf = inputs.rdf_documents(spark, sf)
    number = F.regexp_extract("file_name", "([0-9]+)", 1).cast("bigint")
    folders = [
        _write_each(rdf.where(F.pmod(number, F.lit(2)) == part).select(F.col("file_name").alias("name"), "xml"), "xml") for part in (0, 1)
    ]
    out = artifacts.temporary_path(spark, "metadata")
    pipelines.stored_metadata(spark, folders[:1], out)
    found = _summary(pipelines.stored_metadata(spark, folders, out))
    return found.withColumn("n_files", F.lit(files.count_files_by_folder(spark, folders)).cast("bigint"))


@query
def book_metadata(spark, sf):
    """Subjects of scanned files, stored by the first call and loaded by the second."""
    path, out = written_metadata(spark, sf), artifacts.temporary_path(spark, "metadata")
    pipelines.book_metadata(spark, path, out)
    return _subject_rows(pipelines.book_metadata(spark, path, out), "ebook_id", "birth_year")


@query
def stored_metadata(spark, sf):
    """Built and stored by the first call, loaded by the second."""
    path = artifacts.temporary_path(spark, "metadata")
    artifacts.read_or_build(spark, path, lambda: _metadata(spark, sf))
    return _summary(artifacts.read_or_build(spark, path, lambda: _metadata(spark, sf).limit(0)), "file_name")


# --- looks -----------------------------------------------------------------------


@query
def drawn_counts(spark, sf):
    return sampling.sample_with_replacement(term_counts(spark, sf), 4, 0, "doc_id", "term")


@query
def first_counts(spark, sf):
    return sampling.first_rows(term_counts(spark, sf), 20, F.desc("n"), "doc_id", "term")


# --- learning ----------------------------------------------------------------------


def _vectors(spark, sf, *parts: int, profile: DataFrame | None = None) -> DataFrame:
    """Vectors of rounded cells, so that sums in another order still give the same weights and splits."""
    cells = vec.hash_cells(profile or staged_profile(spark, sf), parts if len(parts) > 1 else parts[0], by_document=True)
    return vec.feature_vectors(rounded(cells, "value"), sum(parts))


def _stored_metadata(spark, sf) -> DataFrame:
    return artifacts.staged(_metadata(spark, sf), "metadata")


def _labelled(spark, sf, *parts: int, profile: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    vectors = _vectors(spark, sf, *(parts or (fv.VECTOR_SIZE,)), profile=profile)
    artifacts.delete_shuffles(spark)  # of cells, before vectors are moved
    found = learn.labelled(vectors, _stored_metadata(spark, sf))
    artifacts.discard(vectors)  # the labelled rows hold them
    return found


@query
def learning_rows(spark, sf):
    """Labels, part and fold of each document, as the learning queries use them."""
    documents = inputs.documents(spark, sf).select("doc_id", F.lit(None).cast(ex.VECTOR).alias("features"))
    rows, names = learn.labelled(documents, _stored_metadata(spark, sf))
    subject = F.array(*[F.lit(n) for n in names])
    each = rows.select("doc_id", "testing", "fold", F.inline(F.arrays_zip(subject.alias("subject"), F.col("labels").alias("label"))))
    return each.withColumn("label", F.col("label").cast("int"))


@query
def majority_errors(spark, sf):
    """Error of always predicting the more frequent label of the training part: what every classifier should beat."""
    rows = learning_rows(spark, sf)
    part = rows.groupBy("subject").agg(
        F.avg(F.when(~F.col("testing"), F.col("label"))).alias("p"), F.avg(F.when(F.col("testing"), F.col("label"))).alias("q"),
        F.count_if(~F.col("testing")).alias("n_training"), F.count_if("testing").alias("n_testing"),
    )
    one = F.col("p") > 0.5
    errors = part.select(
        "subject", "n_training", "n_testing", F.when(one, 1 - F.col("p")).otherwise(F.col("p")).alias("training_error"),
        F.when(one, 1 - F.col("q")).otherwise(F.col("q")).alias("testing_error"),
    )
    return rounded(errors, "training_error", "testing_error")


@query
def naive_bayes_weights(spark, sf):
    """Log odds that a bucket adds to each subject, and each subject's own as bucket -1."""
    rows, names = _labelled(spark, sf)
    model, subject = bayes.fit(rows, len(names)), F.array(*[F.lit(n) for n in names])
    weights = model.weights.select("bucket", F.inline(F.arrays_zip(subject.alias("subject"), F.col("weights").alias("weight"))))
    priors = spark.createDataFrame([(-1, *p) for p in zip(names, model.priors, strict=True)], "bucket int, subject string, weight double")
    return rounded(weights.unionByName(priors), "weight", digits=5)


def _predictions(rows: DataFrame, names: list[str], *methods: learn.Method) -> DataFrame:
    return learn.subject_predictions(rows, names, methods)


@query
def naive_bayes_predictions(spark, sf):
    found = _predictions(*_labelled(spark, sf), learn.naive_bayes())
    return found.select("doc_id", "subject", "testing", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query
def naive_bayes_errors(spark, sf):
    errors = learn.errors_of(_predictions(*_labelled(spark, sf), learn.naive_bayes()))
    return rounded(errors, "training_error", "testing_error").select("subject", "training_error", "testing_error")


@query
def vector_size_naive_bayes(spark, sf):
    """Errors of one method by vector size."""
    counted, result = staged_profile(spark, sf), None
    for size in SIZES:
        errors = learn.errors_of(_predictions(*_labelled(spark, sf, size, profile=counted), learn.naive_bayes()))
        one = rounded(errors, "training_error", "testing_error").select(F.lit(size).alias("size"), "subject", "training_error", "testing_error")
        result = one if result is None else result.unionByName(one)
    return result


@query
def double_hash_pairs(spark, sf):
    """Test rows that Naive Bayes on single or on double hashing alone gets right."""
    counted = staged_profile(spark, sf)

    def judged(*parts: int) -> DataFrame:
        rows, names = _labelled(spark, sf, *parts, profile=counted)
        found = _predictions(rows, names, learn.naive_bayes())
        artifacts.discard(rows)
        return found

    single, double = judged(), judged(*vec.double_hash_sizes())
    return learn.paired_counts(single, double).select("subject", "both", "first_only", "second_only", "neither")


@query
def tree_splits(spark, sf):
    """Splits of the first two levels of each subject's tree, and the training rows that reach them."""
    rows, names = _labelled(spark, sf)
    forest = trees.grow(rows, len(names), (), 2)
    found = [
        (names[s], node, int(forest.bucket[t, node]), int(forest.edge[t, node]), int(forest.count[t, node]), int(forest.positive[t, node]))
        for t, s in enumerate(forest.subject) for node in range(3) if forest.bucket[t, node] >= 0
    ]
    return spark.createDataFrame(found, "subject string, node int, bucket int, edge int, n bigint, positive bigint")


@query
def shallow_tree_errors(spark, sf):
    errors = learn.errors_of(_predictions(*_labelled(spark, sf), learn.decision_tree((2,))))
    return rounded(errors, "training_error", "testing_error").select("subject", "training_error", "testing_error")


PENALTY = 0.01


@query
def logistic_optimum(spark, sf):
    """Whether the stored weights of each subject's regression make the gradient vanish, which is recomputed from tidy cells."""
    rows, names = _labelled(spark, sf)
    block = linear.Logistic(rows, ex.settings(len(names), (), (PENALTY,)))
    norms = linear.gradient_norms(rows, block.weights(block.fit(rounds=300, tolerance=5e-4)).tolist(), PENALTY)
    subject = F.array(*[F.lit(n) for n in names])[F.col("place")]
    return norms.select(subject.alias("subject"), "n_training", (F.col("norm") < 1e-3).alias("optimal"))


LASSO_PENALTIES = (0.1, 1.0, 10.0)


@query
def lasso_optimum(spark, sf):
    """Whether correlations with what each lasso leaves are within the penalty, and equal to it where a weight is not zero."""
    rows = learn.birth_year_rows(_vectors(spark, sf, fv.VECTOR_SIZE), _stored_metadata(spark, sf))
    lassos = linear.Lassos(rows, LASSO_PENALTIES)
    weights, result = lassos.weights(lassos.fit()), None
    n = rows.where(~F.col("testing")).count()
    for place, penalty in enumerate(LASSO_PENALTIES):
        found = linear.lasso_correlations(rows, weights[:, place].tolist())
        size, pull = F.col("scaled_weight"), F.col("correlation")
        kept = F.abs(pull - penalty * F.sign(size)) < 1e-5
        ok = F.when(F.abs(size) > 0, kept).otherwise(F.abs(pull) < penalty + 1e-5)
        one = found.agg(F.bool_and(ok).alias("optimal")).select(F.lit(penalty).alias("reg_param"), F.lit(n).cast("bigint").alias("n_training"), "optimal")
        result = one if result is None else result.unionByName(one)
    return result


@query
def subject_classifiers(spark, sf):
    """Naive Bayes, tree and logistic regression with one setting, for the ten top subjects."""
    rows, names = _labelled(spark, sf)
    return learn.subject_errors(rows, names, [learn.naive_bayes(), learn.decision_tree((5,)), learn.logistic_regression((PENALTY,))])


@query
def cross_validated_errors(spark, sf):
    rows, names = _labelled(spark, sf)
    return learn.subject_errors(rows, names, [learn.decision_tree(), learn.logistic_regression()])


@query
def vector_size_errors(spark, sf):
    counted = staged_profile(spark, sf)
    sizes = {f"size {size}": _vectors(spark, sf, size, profile=counted) for size in SIZES}
    return learn.compare_features(sizes, _stored_metadata(spark, sf))


@query
def double_hash_errors(spark, sf):
    counted = staged_profile(spark, sf)
    pair = {"single": _vectors(spark, sf, fv.VECTOR_SIZE, profile=counted), "double": _vectors(spark, sf, *vec.double_hash_sizes(), profile=counted)}
    return learn.compare_features(pair, _stored_metadata(spark, sf))


@query
def birth_year_errors(spark, sf):
    return learn.birth_year_regression(_vectors(spark, sf, fv.VECTOR_SIZE), _stored_metadata(spark, sf), LASSO_PENALTIES)
