"""Boosting in a task a class makes the models of Spark's learner, in a few jobs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from iotlens.operators import boosting, models

FEATURES = ["f00", "f01", "f02", "f03"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 2, 500), rng.integers(0, 5, 500) / 4.0, rng.random(500), np.ones(500)])
    label = np.where(x[:, 1] + rng.normal(0, 0.3, 500) > 0.6, "flood", np.where(x[:, 2] + rng.normal(0, 0.2, 500) > 0.6, "abuse", "benign"))
    x = np.concatenate([x, np.repeat(x[:20], 20, axis=0)])
    label = np.concatenate([label, np.repeat(label[:20], 20)])
    data = [(k, str(c), *map(float, v)) for k, (c, v) in enumerate(zip(label, x))]
    return spark.createDataFrame(data, "event_id long, label string, f00 double, f01 double, f02 double, f03 double")


def _short(model, rounds, **settings):
    def builder(f, k):
        steps = models.BUILDERS[model](f, k)
        steps[-1].setClassifier(steps[-1].getClassifier().copy().setMaxIter(rounds))
        for name, value in settings.items():
            steps[-1].getClassifier()._set(**{name: value})
        return steps

    return builder


def _both(monkeypatch, rows, model, builder):
    mine = models.fit(rows, model, FEATURES, builder)
    with monkeypatch.context() as m:
        m.setattr(boosting, "follows", lambda learner: False)
        return mine, models.fit(rows, model, FEATURES, builder)


@pytest.mark.parametrize("model,settings", [("boosted_trees", {"featureSubsetStrategy": "0.5"}), ("hist_boosting", {})])
def test_models_are_those_of_sparks_learner(monkeypatch, rows, model, settings):
    some = rows.filter("event_id < 240")  # fewer rows than bins: each is a kind of its own
    mine, other = _both(monkeypatch, some, model, _short(model, 4, **settings))
    ours, theirs = mine.stages[-2].models, other.stages[-2].models
    assert len(ours) == len(theirs) == 3
    for a, b in zip(ours, theirs):
        assert isinstance(a, GBTClassificationModel) and len(a.trees) == 4 and a.numFeatures == b.numFeatures
        assert a.treeWeights == b.treeWeights and a.totalNumNodes == b.totalNumNodes
        assert a.featureImportances.toArray() == pytest.approx(b.featureImportances.toArray(), abs=1e-9)
        assert a.toDebugString.count("feature") == b.toDebugString.count("feature")


def test_equal_rows_are_added_up(monkeypatch, rows):
    """Sums in another order may break a tie otherwise, so some trees differ."""
    mine, other = (m.transform(rows).select("event_id", "predicted") for m in _both(monkeypatch, rows, "boosted_trees", _short("boosted_trees", 4)))
    assert mine.exceptAll(other).count() <= 0.03 * rows.count()
    table = boosting._Table(iter(np.array([[0.0, 1, 0, 1, 1], [5, 5, 5, 5, 5]])), np.ones(5), 255)
    label, kind = table.merged(np.array([1.0, 1, 1, -1, 1]))
    assert (label.tolist(), kind.tolist(), table.bins.tolist()) == ([1, 1, -1], [0, 1, 0, 2, 1], [[0, 1, 1]])


def test_jobs_do_not_go_by_rounds(spark, rows):
    def jobs(rounds):
        group = f"boosting-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        models.fit(rows, "boosted_trees", FEATURES, _short("boosted_trees", rounds))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        few, many = jobs(2), jobs(20)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert abs(many - few) <= 3


def test_saved_and_without_variation(spark, rows, tmp_path):
    fitted = models.fit(rows, "hist_boosting", FEATURES, _short("hist_boosting", 3))
    models.save(fitted, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert models.predict(fitted, rows).exceptAll(models.predict(again, rows)).isEmpty()
    assert models.feature_importance(fitted, FEATURES)[0][1] > 0
    flat = rows.select("event_id", "label", *[F.lit(1.0).alias(f) for f in FEATURES])
    for model in ("boosted_trees", "hist_boosting"):
        flat_fit = models.fit(flat, model, FEATURES, _short(model, 2))
        assert models.predict(flat_fit, flat).select("predicted").distinct().count() == 1
        one = rows.filter("label = 'benign'")
        assert models.predict(models.fit(one, model, FEATURES, _short(model, 2)), one).filter("predicted <> 'benign'").isEmpty()
