"""Corpus analytics on Spark DataFrames."""

from tomewright.functions.header import DEFAULT_RULES, BookFormat, HeaderRules
from tomewright.operators.extract import best_edition, documents, first_edition, line_documents
from tomewright.operators.postings import posting_lists, postings
from tomewright.operators.profiles import profiles, term_counts, tokens
from tomewright.operators.vectors import feature_vectors, hash_cells
from tomewright.operators.weights import term_frequency, tfidf, top_terms, vocabulary
from tomewright.sources.artifacts import read_or_build, staged
from tomewright.sources.files import book_files, book_files_by_charset, stop_words
from tomewright.sources.metadata import metadata_files

__all__ = [
    "DEFAULT_RULES", "BookFormat", "HeaderRules", "best_edition", "book_files", "book_files_by_charset", "documents",
    "feature_vectors", "first_edition", "hash_cells", "line_documents", "metadata_files", "posting_lists", "postings",
    "profiles", "read_or_build", "staged", "stop_words", "term_counts", "term_frequency", "tfidf",
    "tokens", "top_terms", "vocabulary",
]
