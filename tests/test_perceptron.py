"""The perceptron over counted rows is Spark's over single rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from iotlens.operators import models, perceptron

FEATURES = ["f00", "f01"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (700, 2)) / 4.0
    label = np.where(x[:, 0] + rng.normal(0, 0.3, 700) > 0.5, "flood", "benign")
    label[rng.random(700) < 0.1] = "other"
    made = [(str(c), float(a), float(b)) for c, (a, b) in zip(label, x)] + [(None, 0.5, 0.5)]
    return spark.createDataFrame(made, "label string, f00 double, f01 double")


def _net(iterations):
    def builder(features, classes):
        # One block holds all rows, so that Spark's mean over blocks is that over rows.
        net = MultilayerPerceptronClassifier(labelCol="label_index", layers=[len(features), 5, 4, classes], maxIter=iterations, blockSize=4096, seed=7)
        return [*models._scaled(features), net]

    return builder


def _single(rows, builder):
    known = rows.filter(F.col("label").isNotNull()).coalesce(1)
    indexer = models.label_indexer().fit(known)
    return Pipeline(stages=[indexer, *builder(FEATURES, len(indexer.labels) + 1)]).fit(known).stages[-1]


@pytest.mark.parametrize("iterations", [0, 1, 25])
def test_weights_are_those_over_single_rows(rows, iterations):
    builder = _net(iterations)
    fitted = models.fit(rows, "m", FEATURES, builder)
    assert fitted.stages[-2].weights.toArray() == pytest.approx(_single(rows, builder).weights.toArray(), abs=1e-6)
    assert fitted.transform(rows).count() == 701


def test_each_vector_is_read_once(monkeypatch, rows):
    seen = []

    def fit(learner, table, count):
        seen.append((table.count(), table.agg(F.sum(count)).first()[0]))
        return perceptron.fit(learner, table, count)

    monkeypatch.setattr(models, "fit_perceptron", fit)
    models.fit(rows, "m", FEATURES, _net(2))
    known = rows.filter(F.col("label").isNotNull())
    assert seen == [(known.distinct().count(), 700)]


def test_search_ends_at_the_least_point():
    def passes(x):
        return float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2) + 1.0, np.array(
            [2 * (x[0] - 1) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    assert perceptron.minimise(passes, np.array([-1.2, 1.0]), 500, 1e-14) == pytest.approx([1.0, 1.0], abs=1e-4)
    assert perceptron.minimise(passes, np.array([-1.2, 1.0]), 0, 1e-14) == pytest.approx([-1.2, 1.0])
