"""Subject classifiers and birth-year regression on document vectors.

All subjects, values and folds of a method are fitted side by side, so each pass over
the rows serves all of them; what the driver holds is bounded by the length of the
vectors and the number of models.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright import fixed_values as fv
from tomewright.functions.hashing import term_hash
from tomewright.operators import bayes, linear, trees
from tomewright.operators.examples import VECTOR, cells, filled
from tomewright.operators.subjects import book_subjects, top_subjects
from tomewright.sources.artifacts import stage, staged

PREDICTIONS = ("subject", "method", "setting", "value", "fold", "testing", "label", "prediction")
REGRESSION = (
    "reg_param double, training_rmse double, testing_rmse double, n_weights bigint, n_training bigint, n_testing bigint"
)


@dataclass(frozen=True)
class Method:
    """A classifier and, if it is tuned, its setting with values to try.

    ``predict(rows, k, key, folds)`` gives ``key, place, value, fold, testing, label,
    prediction`` for all ``k`` subjects.
    """

    name: str
    predict: Callable[[DataFrame, int, str, Sequence[int]], DataFrame]
    setting: str | None = None
    values: Sequence[float] = ()


def naive_bayes(smoothing: float = 1.0) -> Method:
    return Method("naive_bayes", lambda rows, k, key, folds: bayes.predictions(rows, k, key, smoothing))


def decision_tree(depths: Sequence[int] = (2, 5, 8)) -> Method:
    return Method("decision_tree", partial(trees.predictions, depths=tuple(depths)), "depth", tuple(depths))


def logistic_regression(penalties: Sequence[float] = (0.001, 0.01, 0.1)) -> Method:
    return Method("logistic_regression", partial(linear.predictions, penalties=tuple(penalties)), "penalty", tuple(penalties))


def default_methods() -> list[Method]:
    return [naive_bayes(), decision_tree(), logistic_regression()]


def with_parts(rows: DataFrame, key: str, testing: float = 0.25, folds: int = 3, seed: int = 0) -> DataFrame:
    """Adds ``testing boolean`` and ``fold int`` by a portable hash of the key.

    Unlike a random split it is the same after a retry and for any partitioning.
    """

    def ticket(salt: int) -> Column:
        return term_hash(F.concat_ws("|", F.lit(str(salt)), F.col(key).cast("string")))

    return rows.withColumns(
        {
            "testing": ticket(seed) % 1_000_000 < int(testing * 1_000_000),
            "fold": (ticket(seed + 1) % folds).cast("int"),
        }
    )


def labelled(
    vectors: DataFrame, metadata: DataFrame, k: int = fv.TOP_SUBJECTS, key: str = "doc_id", folds: int = 3, seed: int = 0
) -> tuple[DataFrame, list[str]]:
    """``vectors`` with ``labels array<double>``, one label for each of the top subjects."""
    names = [row.subject for row in top_subjects(metadata, k).collect()]
    listed = book_subjects(metadata).where(F.col("subject").isin(names))
    own = listed.groupBy(F.col("ebook_id").alias(key)).agg(F.collect_list("subject").alias("own"))
    labels = F.array(*[F.coalesce(F.array_contains("own", n), F.lit(False)).cast("double") for n in names])
    joined = vectors.withColumn(key, F.col(key).cast("string")).join(own, key, "left")
    rows = with_parts(joined.select(key, "features", labels.alias("labels")), key, folds=folds, seed=seed)
    return stored_rows(rows), names


def stored_rows(rows: DataFrame) -> DataFrame:
    """The rows written once, with vectors in the layout they are stored in.

    Rows of few files are dealt evenly to as many as there are cores, since the passes that
    follow are bound by computing; files larger than a task's share are split when read.
    Those of many files are enough for all cores where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    path = stage(rows if len(rows.inputFiles()) >= 2 * cores else rows.repartition(cores), "labelled")
    fields = [f"`{f.name}` {VECTOR if f.name == 'features' else f.dataType.simpleString()}" for f in rows.schema]
    return rows.sparkSession.read.schema(", ".join(fields)).parquet(path)


def subject_predictions(
    rows: DataFrame, names: Sequence[str], methods: Iterable[Method] | None = None, folds: int = 3, key: str = "doc_id"
) -> DataFrame:
    """``key, subject, method, setting, value, fold, testing, label, prediction``, written once.

    Models of the whole training part judge every row, with a null ``fold``.  Where there
    are values to choose from, models without a fold judge that fold's training rows.
    """
    result = None
    for method in methods or default_methods():
        found = method.predict(rows, len(names), key, range(folds))
        named = found.select(
            key, F.array(*map(F.lit, names))[F.col("place")].alias("subject"), F.lit(method.name).alias("method"),
            F.lit(method.setting).cast("string").alias("setting"), "value", "fold", "testing", "label", "prediction",
        )
        named = staged(named, "predictions")
        result = named if result is None else result.unionByName(named)
    return result


def errors_of(predictions: DataFrame) -> DataFrame:
    """``subject, method, setting, value, chosen, training_error, validation_error, testing_error``.

    Errors are shares of wrong predictions; the validation error is the mean over the
    folds.  The value of least validation error is ``chosen``, of equal ones the first.
    A method without values to choose from has one row without validation error.
    """
    wrong = (F.col("prediction") != F.col("label")).cast("double")
    group = ("subject", "method", "setting", "value")
    by_fold = predictions.groupBy(*group, "fold").agg(
        F.avg(F.when(~F.col("testing"), wrong)).alias("train"), F.avg(F.when(F.col("testing"), wrong)).alias("test")
    )
    whole = F.col("fold").isNull()
    errors = by_fold.groupBy(*group).agg(
        F.max(F.when(whole, F.col("train"))).alias("training_error"), F.avg(F.when(~whole, F.col("train"))).alias("validation_error"),
        F.max(F.when(whole, F.col("test"))).alias("testing_error"),
    )
    order = Window.partitionBy("subject", "method").orderBy(F.round("validation_error", 9), "value")
    return errors.select(*group, (F.row_number().over(order) == 1).alias("chosen"), "training_error", "validation_error", "testing_error")


def subject_errors(
    rows: DataFrame, names: Sequence[str], methods: Iterable[Method] | None = None, folds: int = 3, key: str = "doc_id"
) -> DataFrame:
    """``errors_of`` the predictions of all methods."""
    return errors_of(subject_predictions(rows, names, methods, folds, key))


@contextmanager
def measured_work(spark: SparkSession) -> Iterator[dict[str, float]]:
    """Run time and memory of all jobs that the block starts, from Spark's status store.

    ``seconds`` passed, ``task_seconds`` in tasks, and ``peak_task_bytes`` of memory
    that the tasks of one stage took for sorts, joins and aggregates.
    """
    tag, found = f"measured-{uuid.uuid4().hex}", {}
    context, started = spark.sparkContext, time.perf_counter()
    before = {name: context.getLocalProperty(name) for name in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(tag, "measured work")
    try:
        yield found
    finally:
        for name, value in before.items():
            context.setLocalProperty(name, value)
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        status, store = context.statusTracker(), context._jsc.sc().statusStore()
        stages = {s for j in status.getJobIdsForGroup(tag) if (info := status.getJobInfo(j)) for s in info.stageIds}
        attempts = [a for s in sorted(stages) if (a := _last_attempt(store, s))]
        found["seconds"] = time.perf_counter() - started
        found["task_seconds"] = sum(a.executorRunTime() for a in attempts) / 1000
        found["peak_task_bytes"] = max([a.peakExecutionMemory() for a in attempts], default=0)


def _last_attempt(store, stage: int):
    """What the status store has of a stage; stages that were skipped, or that it has dropped, are none."""
    try:
        return store.lastStageAttempt(stage)
    except Exception:
        return None


def compare_features(
    features: Mapping[str, DataFrame],
    metadata: DataFrame,
    methods: Iterable[Method] | None = None,
    k: int = fv.TOP_SUBJECTS,
    key: str = "doc_id",
    folds: int = 3,
) -> DataFrame:
    """``errors_of`` several sets of vectors, named in the column ``features``, with what they took.

    For vector sizes, and for single against double hashing.  ``seconds``, ``task_seconds``
    and ``peak_task_bytes`` are measured over all fits and predictions of a set,
    ``vector_cells`` are its filled cells.
    """
    methods = list(methods or default_methods())
    result = None
    for name, vectors in features.items():
        rows, names = labelled(vectors, metadata, k, key, folds)
        with measured_work(rows.sparkSession) as work:
            found = subject_predictions(rows, names, methods, folds, key)
        n_cells = filled(rows).agg(F.sum(F.size("values"))).first()[0] or 0
        errors = errors_of(found).withColumns(
            {
                "features": F.lit(name), "seconds": F.lit(work["seconds"]), "task_seconds": F.lit(work["task_seconds"]),
                "peak_task_bytes": F.lit(work["peak_task_bytes"]).cast("bigint"), "vector_cells": F.lit(n_cells).cast("bigint"),
            }
        )
        result = errors if result is None else result.unionByName(errors)
    return result


def paired_counts(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """``subject, method, value, both, first_only, second_only, neither``: test rows that two sets of predictions get right.

    Both are predictions on the same rows; those of whole models are compared.
    """

    def right(predictions: DataFrame, name: str) -> DataFrame:
        kept = predictions.where(F.col("testing") & F.col("fold").isNull())
        return kept.select(key, "subject", "method", F.coalesce("value", F.lit(0.0)).alias("value"), (F.col("prediction") == F.col("label")).alias(name))

    joined = right(first, "a").join(right(second, "b"), [key, "subject", "method", "value"])
    a, b = F.col("a"), F.col("b")
    return joined.groupBy("subject", "method", "value").agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"),
        F.count_if(~a & ~b).alias("neither"),
    )


def birth_year_rows(vectors: DataFrame, metadata: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Rows of books whose author's year of birth is known, the year as their only label."""
    years = metadata.where(F.col("birth_year").isNotNull()).groupBy(F.col("ebook_id").alias(key)).agg(
        F.array(F.min("birth_year").cast("double")).alias("labels")
    )
    joined = vectors.withColumn(key, F.col(key).cast("string")).join(years, key)
    return stored_rows(with_parts(joined, key, seed=seed))


def birth_year_regression(
    vectors: DataFrame,
    metadata: DataFrame,
    penalties: Sequence[float] = (0.1, 1.0, 10.0),
    key: str = "doc_id",
    seed: int = 0,
) -> DataFrame:
    """Lasso regression of the author's year of birth on document vectors.

    One row for each penalty: root mean squared errors and the number of
    weights that the penalty leaves.
    """
    rows = birth_year_rows(vectors, metadata, key, seed)
    lassos = linear.Lassos(rows, penalties)
    scaled = lassos.fit()
    return _regression_errors(rows, penalties, lassos.weights(scaled), (scaled != 0).sum(axis=0).tolist(), key)


def _regression_errors(rows: DataFrame, penalties: Sequence[float], weights, n_weights: list[int], key: str) -> DataFrame:
    """Errors of all penalties' models in both parts, by a join of cells and weights."""
    spark, every = rows.sparkSession, range(len(penalties))
    table = spark.createDataFrame([(b, [float(x) for x in w]) for b, w in enumerate(weights[:-1])], "bucket int, weights array<double>")
    own = cells(rows, F.col(key).alias("_key")).join(table, "bucket")
    said = own.groupBy("_key").agg(F.array(*[F.sum(F.col("value") * F.col("weights")[p]) for p in every]).alias("said"))
    joined = rows.select(F.col(key).alias("_key"), "testing", F.col("labels")[0].alias("label")).join(said, "_key", "left")

    def rmse(p: int, testing: bool) -> Column:
        left = F.col("label") - F.coalesce(F.col("said")[p], F.lit(0.0)) - float(weights[-1][p])
        return F.sqrt(F.avg(F.when(F.col("testing") == testing, left * left)))

    counts = [F.count_if(~F.col("testing")).alias("n_training"), F.count_if("testing").alias("n_testing")]
    found = joined.agg(F.array(*[rmse(p, False) for p in every]).alias("train"), F.array(*[rmse(p, True) for p in every]).alias("test"), *counts).first()
    table = [
        (float(penalty), found["train"][p], found["test"][p], int(n_weights[p]), found["n_training"], found["n_testing"])
        for p, penalty in enumerate(penalties)
    ]
    return spark.createDataFrame(table, REGRESSION)
