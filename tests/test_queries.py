"""Each registered query against its SQL twin in DuckDB."""

import pytest

import __spark_entry__ as contract
from checks import compare
from checks.oracle import SQL
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    good, note = compare.compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert good, note


def test_column_types_agree(spark, con):
    for name in ("term_counts", "hash_cells", "book_documents", "top_subjects", "tfidf_top_terms", "header_fields"):
        types = dict(QUERIES[name](spark, SF).dtypes)
        wanted = {d[0]: str(d[1]).lower() for d in con.execute(SQL[name]).description}
        assert all(compare._alike(types[c], wanted[c]) for c in types), (name, types, wanted)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "term", "rank", "tfidf"}


def test_registered(spark):
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_queries_without_sql_are_only_the_learning_ones():
    assert set(QUERIES) - set(SQL) == {
        "subject_classifiers", "cross_validated_errors", "vector_size_errors", "double_hash_errors", "birth_year_errors",
    }
