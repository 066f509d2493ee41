"""Classifiers and regressions of many models at once, against MLlib and plain computations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tomewright.operators import bayes, learn, linear, trees
from tomewright.operators import examples as ex

N, D, K = 240, 14, 3


@pytest.fixture(scope="module")
def numbers():
    made = np.random.default_rng(0)
    x = np.where(made.random((N, D)) < 0.3, made.gamma(2, 0.4, (N, D)), 0)
    x[5] = 0
    score = x @ (made.normal(size=(D, K)) * 2)
    return x, (score + made.normal(size=(N, K)) > np.median(score, axis=0)).astype(float), 1800 + x @ made.normal(size=D) * 5


@pytest.fixture(scope="module")
def rows(spark, numbers):
    x, y, _ = numbers
    # One dense vector among the sparse ones.
    vectors = [(str(i), Vectors.dense(r) if i == 7 else Vectors.sparse(D, [(j, float(r[j])) for j in np.flatnonzero(r)]), y[i].tolist()) for i, r in enumerate(x)]
    return learn.with_parts(spark.createDataFrame(vectors, ["doc_id", "features", "labels"]), "doc_id").cache()


@pytest.fixture(scope="module")
def stored(rows):
    return learn.stored_rows(rows)


def of(rows, subject, without=-1):
    kept = rows.where(~F.col("testing") & (F.col("fold") != without))
    return kept.select("features", F.col("labels")[subject].alias("label"))


def test_naive_bayes_is_that_of_the_library(rows, stored):
    got = {r.doc_id: r.margins for r in bayes.margins(stored, bayes.fit(stored, K), "doc_id").collect()}
    for s in range(K):
        model = NaiveBayes().fit(of(rows, s))
        for r in model.transform(rows).select("doc_id", "rawPrediction").collect():
            assert got[r.doc_id][s] == pytest.approx(r.rawPrediction[1] - r.rawPrediction[0], abs=1e-9)


def test_logistic_regressions_are_those_of_the_library(rows, stored):
    block = linear.Logistic(stored, ex.settings(K, range(3), (0.01, 0.1)))
    weights = block.weights(block.fit(rounds=150, tolerance=1e-6))
    assert len(block.models) == K * 4 * 2
    for m in (0, 3, 9, 20):
        s, without, penalty = block.models[m].subject, block.models[m].without, block.models[m].value
        model = LogisticRegression(maxIter=500, tol=1e-12, regParam=penalty).fit(of(rows, s, without))
        assert np.abs(model.coefficients.toArray() - weights[:-1, m]).max() < 1e-3 and abs(model.intercept - weights[-1, m]) < 1e-3
    one = linear.Logistic(stored, ex.settings(K, (), (0.01,)))
    best = one.weights(one.fit(rounds=150, tolerance=1e-6))
    assert all(r.norm < 1e-5 for r in linear.gradient_norms(stored, best.tolist(), 0.01).collect())
    best[3] += 0.1
    assert all(r.norm > 1e-4 for r in linear.gradient_norms(stored, best.tolist(), 0.01).collect())


def test_lassos_are_those_of_the_library(spark, numbers, rows):
    years = spark.createDataFrame([(str(i), [float(v)]) for i, v in enumerate(numbers[2])], "doc_id string, labels array<double>")
    own = learn.stored_rows(rows.drop("labels").join(years, "doc_id"))
    penalties = (0.05, 0.5, 2.0)
    lassos = linear.Lassos(own, penalties)
    scaled = lassos.fit()
    weights = lassos.weights(scaled)
    training = rows.drop("labels").join(years, "doc_id").where("not testing").select("features", F.col("labels")[0].alias("label"))
    for p, penalty in enumerate(penalties):
        model = LinearRegression(solver="l-bfgs", elasticNetParam=1.0, regParam=penalty, maxIter=1000, tol=1e-12).fit(training)
        assert np.abs(model.coefficients.toArray() - weights[:-1, p]).max() < 1e-4 and abs(model.intercept - weights[-1, p]) < 1e-3
        found = {r.bucket: r for r in linear.lasso_correlations(own, weights[:, p].tolist()).collect()}
        for bucket, r in found.items():
            assert abs(r.correlation) < penalty + 1e-6
            if scaled[bucket, p]:
                assert r.correlation == pytest.approx(penalty * np.sign(scaled[bucket, p]), abs=1e-6)


def test_lasso_products_stay_in_tasks(spark, numbers, rows, monkeypatch):
    years = spark.createDataFrame([(str(i), [float(v)]) for i, v in enumerate(numbers[2])], "doc_id string, labels array<double>")
    own = learn.stored_rows(rows.drop("labels").join(years, "doc_id"))
    monkeypatch.setattr(linear, "TASK_PRODUCTS", 3 * D)
    lassos = linear.Lassos(own, (0.05,))
    active = np.array([0, 2, 3, 5, 7, 8, 11])
    parts = {r["slice"]: np.frombuffer(r["part"]) for r in lassos.products(active).collect()}
    kept = [int(r.doc_id) for r in own.where("not testing").select("doc_id").collect()]
    x, y = numbers[0][kept][:, active], numbers[2][kept]
    assert sorted(parts) == list(range(8)) and np.allclose(parts[7], x.T @ (y - y.mean()))
    assert all(np.allclose(parts[k], (x.T @ x)[k, k:]) for k in range(7))
    few = lassos.fit()
    monkeypatch.undo()
    assert np.allclose(few, lassos.fit())


def test_lasso_of_nearly_equal_features():
    made = np.random.default_rng(1)
    x = made.normal(size=(300, 3))[:, [0] * 40 + [1] * 40 + [2] * 40] + made.normal(size=(300, 120)) * 0.01
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    products, aims = x.T @ x / 300, x.T @ (x @ made.normal(size=120) + made.normal(size=300)) / 300
    w = linear._shrunk(products, aims, 0.001, np.zeros(120))
    left = aims - products @ w
    assert np.abs(left).max() < 0.001 + 1e-7 and np.abs(left[w != 0] - 0.001 * np.sign(w[w != 0])).max() < 1e-7


def plain_tree(x, y, node, depth, splits):
    """Splits of one tree in heap order, by trying every bucket and edge."""
    n, p = len(y), y.sum()
    if depth == 0 or p in (0, n):
        return

    def impurity(part):
        return 2 * part.mean() * (1 - part.mean()) if len(part) else 0.0

    best = None
    for bucket in range(x.shape[1]):
        for e, edge in enumerate(trees.EDGES):
            left = x[:, bucket] <= edge
            if 0 < left.sum() < n:
                gain = round(impurity(y) - (left.sum() * impurity(y[left]) + (~left).sum() * impurity(y[~left])) / n, 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, bucket, e, left)
    if best:
        _, bucket, e, left = best
        splits[node] = (bucket, e, n, p)
        plain_tree(x[left], y[left], 2 * node + 1, depth - 1, splits)
        plain_tree(x[~left], y[~left], 2 * node + 2, depth - 1, splits)


def test_trees_are_those_of_all_splits(numbers, rows, stored):
    x, y, _ = numbers
    parts = {int(r.doc_id): (r.testing, r.fold) for r in rows.select("doc_id", "testing", "fold").collect()}
    forest = trees.grow(stored, K, range(3), 3)
    assert len(forest.subject) == K * 4
    for t in (0, 2, 4, 11):
        use = [i for i in range(N) if not parts[i][0] and parts[i][1] != forest.without[t]]
        splits = {}
        plain_tree(x[use], y[use, forest.subject[t]], 0, 3, splits)
        got = {i: (forest.bucket[t, i], forest.edge[t, i], forest.count[t, i], forest.positive[t, i]) for i in range(15) if forest.bucket[t, i] >= 0}
        assert got == splits


def test_tree_counts_are_handed_on_a_tree_at_a_time(stored, monkeypatch):
    monkeypatch.setattr(trees, "KEPT", 100)
    forest = trees.grow(stored, K, range(3), 2)
    taken = ex.filled(stored, "labels", "testing", "fold").toArrow().to_batches()
    taken = pa.Table.from_batches(taken).combine_chunks().to_batches()
    got = list(trees._level_counts(forest, 0, D)(iter(taken)))
    # All rows come as one batch and more than a hundred cells: still no more than the counts of one tree at a time.
    assert len(got) >= len(forest.subject) and max(b.num_rows for b in got) <= D * len(trees.EDGES)
    monkeypatch.undo()
    again = trees.grow(stored, K, range(3), 2)
    assert all((getattr(forest, name) == getattr(again, name)).all() for name in ("bucket", "edge", "count", "positive"))


def test_rows_as_matrices_give_the_same_products(stored, monkeypatch):
    batch = pa.Table.from_batches(ex.filled(stored, "labels", "testing", "fold").toArrow().to_batches()).combine_chunks().to_batches()[0]
    weights, out = np.random.default_rng(2).normal(size=(D, 4)), {}
    for most in (0, 60):
        monkeypatch.setattr(ex, "MOST_ZEROS", most)
        (_, block), = ex.blocks(batch)
        assert (block.dense is None) == (most == 0)
        total = np.zeros((D, 4))
        block.turned(block.times(weights), total)
        out[most] = block.times(weights), total
    assert np.allclose(out[0][0], out[60][0]) and np.allclose(out[0][1], out[60][1])


def test_predictions_and_errors(stored):
    names = ["a", "b", "c"]
    found = learn.subject_predictions(stored, names)
    n, training = stored.count(), stored.where("not testing").count()
    assert found.count() == K * (n + 3 * (n + training) * 2)
    errors = {(r.subject, r.method, r.value): r for r in learn.errors_of(found).collect()}
    assert len(errors) == K * (1 + 3 + 3)
    rows = found.where("method = 'decision_tree' and subject = 'b' and value = 5").toPandas()
    rows["wrong"] = rows["prediction"] != rows["label"]
    whole, folds = rows[rows["fold"].isna()], rows[rows["fold"].notna()]
    r = errors["b", "decision_tree", 5.0]
    assert r.training_error == pytest.approx(whole[~whole["testing"]]["wrong"].mean())
    assert r.testing_error == pytest.approx(whole[whole["testing"]]["wrong"].mean())
    assert r.validation_error == pytest.approx(folds.groupby("fold")["wrong"].mean().mean()) and not folds["testing"].any()
    for s in names:
        for method in ("decision_tree", "logistic_regression"):
            own = [r for k, r in errors.items() if k[:2] == (s, method)]
            assert [r.value for r in own if r.chosen] == [min(own, key=lambda r: (r.validation_error, r.value)).value]
    # Labels that depend on the features are learned better than by the more frequent one.
    assert all(errors[s, "logistic_regression", 0.01].testing_error < 0.3 for s in names)
    pairs = learn.paired_counts(found, found).where("method = 'naive_bayes'").collect()
    assert all(r.first_only == r.second_only == 0 and r.both + r.neither == n - training for r in pairs)


def test_no_rows_and_no_cells(spark, stored):
    nothing = stored.limit(0)
    assert learn.subject_predictions(nothing, ["a", "b", "c"], [learn.naive_bayes(), learn.decision_tree((2,))]).count() == 0
    empty = stored.where("doc_id = '5'")
    got = learn.subject_predictions(empty, ["a", "b", "c"], [learn.naive_bayes()])
    assert got.count() == 3


def test_work_is_measured(spark):
    with learn.measured_work(spark) as work:
        spark.range(200_000).repartition(3).groupBy((F.col("id") % 1000).alias("k")).count().orderBy("count").collect()
    assert work["seconds"] > 0 and work["task_seconds"] > 0 and work["peak_task_bytes"] > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_rows_of_many_files_are_not_dealt_again(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for n, dealt in ((2 * cores, False), (1, True)):
        path = str(tmp_path / str(n))
        made = spark.range(0, 2 * cores, 1, n).select(F.col("id").cast("string").alias("doc_id"), F.lit(None).cast(ex.VECTOR).alias("features"))
        made.write.parquet(path)
        rows = spark.read.parquet(path)
        asked = []
        frame = type(rows)
        plain = frame.repartition
        frame.repartition = lambda self, *a: asked.append(a) or plain(self, *a)
        try:
            assert learn.stored_rows(rows).count() == 2 * cores
        finally:
            frame.repartition = plain
        assert bool(asked) == dealt
