"""Queries that once did less than the whole job."""

import pytest

from checks import compare, inputs, queries
from tomewright.operators import learn

SF = "/root/testdata/sf0.001"


def test_stored_books_has_every_book(spark):
    plain = "replace(content, 'encoding: ISO-8859-1', 'encoding: US-ASCII') || chr(10)"
    wanted = compare.connect(SF).execute(
        f"""select cast(doc_id as varchar), cast(octet_length(encode({plain})) as bigint), md5({plain})
        from ({inputs.editions_sql(1)})"""
    ).fetchall()
    found = queries.stored_books(spark, SF).select("doc_id", "file_size", "content_md5").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


@pytest.mark.parametrize("name, sets", [("vector_size_errors", 3), ("double_hash_errors", 2)])
def test_vectors_are_compared_by_every_method(spark, monkeypatch, name, sets):
    tried, schema = [], "doc_id string, subject string, method string, setting string, value double, fold int, testing boolean, label double, prediction double"

    def recorded(rows, names, methods, folds, key):
        tried.append([(m.name, m.setting, tuple(m.values)) for m in methods])
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(learn, "subject_predictions", recorded)
    queries.QUERIES[name](spark, SF)
    assert tried == [[(m.name, m.setting, tuple(m.values)) for m in learn.default_methods()]] * sets
