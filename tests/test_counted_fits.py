"""Fits over counted vectors are those over single rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from iotlens.operators import models

FEATURES = ["f00", "f01"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (600, 2)) / 5.0
    label = np.where(x[:, 0] + rng.normal(0, 0.4, 600) > 0.6, "flood", "benign")
    label[rng.random(600) < 0.05] = "other"
    return spark.createDataFrame([(str(c), float(a), float(b)) for c, (a, b) in zip(label, x)], "label string, f00 double, f01 double")


def _single(monkeypatch, rows, builder):
    with monkeypatch.context() as m:
        m.setattr(models, "_mergeable", lambda learner: False)
        return models.fit(rows, "m", FEATURES, builder)


def test_learner_reads_each_vector_once(rows):
    counts = models.counted(rows, FEATURES)
    assert counts.count() == rows.distinct().count() < 120
    assert counts.agg(F.sum("n")).first()[0] == 600
    assert counts.agg(F.sum("weight")).first()[0] == pytest.approx(models.weighted(rows).agg(F.sum("weight")).first()[0])
    many = rows.limit(1).select("label", *FEATURES, F.lit(7000).cast("long").alias("n"), F.lit(3500.0).alias("weight"))
    for n, pieces in ((1, 1), (16, 16), (17, 16), (7000, 110)):
        got = models.in_pieces(many.withColumn("n", F.lit(n).cast("long"))).agg(F.count("*"), F.sum("n"), F.sum("weight")).first()
        assert tuple(got) == (pieces, pytest.approx(n), pytest.approx(3500.0))


def test_logistic_regression_has_the_same_optimum(monkeypatch, rows):
    def builder(f, k):
        return [*models._scaled(f), LogisticRegression(labelCol="label_index", maxIter=500, tol=1e-12, regParam=0.1, weightCol="weight")]

    skewed = rows.union(rows.limit(1).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("_n"))
    one, other = models.fit(skewed, "m", FEATURES, builder).stages[-2], _single(monkeypatch, skewed, builder).stages[-2]
    assert one.coefficientMatrix.toArray() == pytest.approx(other.coefficientMatrix.toArray(), abs=1e-6)


def test_unweighted_learner_counts_rows(monkeypatch, rows):
    def builder(f, k):
        return [models._assembler(f, "features"), DecisionTreeClassifier(labelCol="label_index", maxDepth=3)]

    one, other = models.fit(rows, "m", FEATURES, builder), _single(monkeypatch, rows, builder)
    a, b = (m.transform(rows).select("predicted").collect() for m in (one, other))
    assert a == b
