"""What the passes of trees and regressions move and read."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import queries
from tests.test_learning import D, K, numbers, rows, stored  # noqa: F401
from tomewright.operators import examples as ex
from tomewright.operators import linear, trees
from tomewright.sources import artifacts


@pytest.fixture()
def forest(stored):  # noqa: F811
    return trees.grow(stored, K, range(3), 2)


def taken(stored):  # noqa: F811
    batches = ex.filled(stored, "labels", "testing", "fold").toArrow().to_batches()
    return pa.Table.from_batches(batches).combine_chunks().to_batches()


def totals(forest, level, size, found):
    """Rows and labels per tree, bucket, open node and interval."""
    out, ends = {}, trees._slices(size)
    for batch in found:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree, place = divmod(part, len(ends))
            slots = int(forest.open(level)[tree].sum())
            for key, n, positive in np.frombuffer(counts, np.int32).reshape(3, -1).T.tolist():
                key += int(ends[place]) * slots * len(trees.EDGES)
                out[tree, key] = n, positive
    return out


def test_counts_move_in_a_few_rows_a_tree(stored, forest, monkeypatch):  # noqa: F811
    monkeypatch.setattr(trees, "SLICES", 3)
    found = list(trees._level_counts(forest, 1, D)(iter(taken(stored))))
    assert 0 < sum(batch.num_rows for batch in found) <= 3 * len(forest.subject)
    whole = totals(forest, 1, D, found)
    # Vectors too long for a place per bucket and node are counted by sorting.
    long = totals(forest, 1, 3_000_000, trees._level_counts(forest, 1, 3_000_000)(iter(taken(stored))))
    assert whole == long and len(whole) > 3 * len(forest.subject)


def test_trees_of_many_tasks_are_those_of_one(stored, forest, monkeypatch):  # noqa: F811
    again = trees.grow(stored.coalesce(1), K, range(3), 2)
    assert all((getattr(forest, name) == getattr(again, name)).all() for name in ("bucket", "edge", "count", "positive"))


def test_regressions_pass_over_training_rows_only(spark, stored):  # noqa: F811
    block = linear.Logistic(stored, ex.settings(K, (), (0.01,)))
    years = stored.withColumn("labels", F.array(F.lit(1.0)))
    assert block.rows.count() == linear.Lassos(years, (0.1,)).rows.count() == stored.where("not testing").count()


def test_blocks_hold_a_bounded_number_of_rows():
    n, most = 1000, 100 * ex.ROW_CELLS
    one = pa.array([[1]] * n, pa.list_(pa.int32()))
    columns = [pa.array([[1.0]] * n), pa.array([False] * n), pa.array([0] * n, pa.int32()), one, pa.array([[0.5]] * n)]
    found = [block for _, block in ex.blocks(pa.RecordBatch.from_arrays(columns, ["labels", "testing", "fold", "indices", "values"]), most)]
    assert max(block.rows for block in found) <= 101 and sum(block.rows for block in found) == n


def test_tables_read_for_the_last_time_are_deleted(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    own, table = artifacts.load(spark, str(tmp_path / "own")), artifacts.staged(spark.range(5), "numbers")
    place = table.inputFiles()[0].rpartition("/")[0]
    assert artifacts.is_complete(spark, place)
    artifacts.discard(table.join(own, "id", "left"))
    assert not artifacts.is_complete(spark, place) and own.count() == 3


def test_vectors_of_pairs_are_not_kept_twice(spark, monkeypatch):
    left, plain = [], artifacts.discard

    def seen(df):
        files = df.inputFiles()
        plain(df)
        left.append([os.path.exists(file.removeprefix("file://")) for file in files])

    monkeypatch.setattr(artifacts, "discard", seen)
    assert queries.double_hash_pairs(spark, "/root/testdata/sf0.001").count() == 10
    # Vectors and labelled rows of both sets.
    assert len(left) == 4 and all(left) and not any(map(any, left))
