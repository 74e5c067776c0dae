"""Training and scoring with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.functions.numeric import score_from_outputs
from iotlens.operators import boosting, evaluate
from iotlens.operators.perceptron import fit as fit_perceptron
from iotlens.schemas import FEATURE_SETS, FEATURES

SEED = 42
# Boosting runs thousands of small jobs over the same rows: a task gets so many rows, so jobs over few rows have few tasks.
ROWS_PER_TASK = 25_000
# Learners that draw rows at random get equal rows one by one up to so many, and beyond in at least so many pieces of at most so many rows.
LEAST_PIECES, ROWS_PER_PIECE = 16, 64


def label_indexer() -> StringIndexer:
    return StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")


def _assembler(features: Sequence[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out)


def _scaled(features: Sequence[str]) -> list:
    return [
        _assembler(features, "_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def logistic_regression(features: Sequence[str], classes: int) -> list:
    return [*_scaled(features), LogisticRegression(labelCol="label_index", maxIter=1200, regParam=1e-4, weightCol="weight")]


def random_forest(features: Sequence[str], classes: int) -> list:
    """As deep as Spark's trees go; the survey's have no limit."""
    forest = RandomForestClassifier(
        labelCol="label_index", numTrees=250, minInstancesPerNode=2, maxDepth=30, weightCol="weight", seed=SEED
    )
    return [_assembler(features, "features"), forest]


def boosted_trees(features: Sequence[str], classes: int) -> list:
    """One booster per class: Spark's boosted trees are binary.  Trees of 31 leaves are trees of depth 5 (32 leaves) here."""
    booster = GBTClassifier(
        maxIter=140, maxDepth=5, stepSize=0.08, maxBins=255, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=SEED
    )
    each = OneVsRest(classifier=booster, labelCol="label_index", weightCol="weight", parallelism=8)
    return [_assembler(features, "features"), each]


def histogram_boosting(features: Sequence[str], classes: int) -> list:
    """More and deeper trees on unweighted rows, one booster per class; Spark has no L2 term for leaves."""
    booster = GBTClassifier(maxIter=180, maxDepth=8, stepSize=0.07, maxBins=255, seed=SEED)
    each = OneVsRest(classifier=booster, labelCol="label_index", parallelism=8)
    return [_assembler(features, "features"), each]


def perceptron(features: Sequence[str], classes: int) -> list:
    """Hidden layers 32 and 16 (sigmoid units)."""
    net = MultilayerPerceptronClassifier(
        labelCol="label_index", layers=[len(features), 32, 16, classes], maxIter=200, seed=SEED
    )
    return [*_scaled(features), net]


BUILDERS: dict[str, Callable[[Sequence[str], int], list]] = {
    "logreg": logistic_regression,
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
    "hist_boosting": histogram_boosting,
    "mlp": perceptron,
}


def weighted(rows: DataFrame) -> DataFrame:
    """Adds the balanced class weight; the weight table has one row per label."""
    return rows.join(evaluate.class_weights(rows).select("label", "weight"), "label")


def counted(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per label and vector, with its number of rows ``n`` and their balanced class weights' sum ``weight``."""
    counts = rows.groupBy("label", *features).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("rows"))
    balanced = evaluate.balanced_weights(totals).select("label", F.col("weight").alias("_each"))
    return counts.join(balanced, "label").withColumn("weight", F.col("_each") * F.col("n"))


def in_pieces(counts: DataFrame) -> DataFrame:
    """Equal rows in pieces, so that random draws take parts of them and a leaf's least number of rows still counts."""
    pieces = F.greatest(F.least(F.col("n"), F.lit(LEAST_PIECES)), F.ceil(F.col("n") / ROWS_PER_PIECE))
    rows = counts.withColumn("_pieces", pieces).withColumn("_piece", F.explode(F.sequence(F.lit(1).cast("long"), "_pieces")))
    return rows.withColumns({c: F.col(c) / F.col("_pieces") for c in ("n", "weight")}).drop("_pieces")


def _draws(learner) -> bool:
    """Whether a learner (or the learner inside one-against-rest) takes random rows."""
    inner = learner.getClassifier() if isinstance(learner, OneVsRest) else learner
    bootstrap = inner.hasParam("bootstrap") and inner.getOrDefault("bootstrap")
    return bootstrap or inner.hasParam("subsamplingRate") and inner.getOrDefault("subsamplingRate") < 1


def _perceptron(learner) -> bool:
    """Whether a learner is the perceptron as :mod:`iotlens.operators.perceptron` fits it."""
    return isinstance(learner, MultilayerPerceptronClassifier) and learner.getSolver() == "l-bfgs"


def _mergeable(learner) -> bool:
    """Whether weights stand for equal rows: the learner has weights, and its penalty is none or that of :func:`_same_penalty`."""
    return _perceptron(learner) or learner.hasParam("weightCol") and not (learner.hasParam("elasticNetParam") and learner.getOrDefault("elasticNetParam") > 0)


def _same_penalty(learner, table: DataFrame):
    """The learner with the penalty that it would have over single rows.

    Spark scales the penalty by variances with the divisor ``W - (sum of squared weights) / W``, which knows only whole weights.
    """
    if not (learner.hasParam("standardization") and learner.hasParam("regParam") and learner.getOrDefault("standardization")):
        return learner
    w = F.col(learner.getOrDefault("weightCol")).cast("double")
    total, single, merged = table.agg(F.sum(w), F.sum(w * w / F.col("n")), F.sum(w * w)).first()
    if not total or total * total <= merged:  # one vector: nothing varies
        return learner
    return learner.copy({learner.regParam: learner.getOrDefault("regParam") * (total - merged / total) / (total - single / total)})


def fit(rows: DataFrame, model: str, features: Sequence[str] = FEATURES, builder=None) -> PipelineModel:
    """Fits a named model; the pipeline maps predictions back to label names.

    Learners read the rows many times.  Those with weights read each vector of a label once, with the number and class weight
    of its rows as weight: the same loss over fewer rows (vectors are made of flags and whole sizes with caps).  Scalers see
    all rows.  The last stage of a builder is the learner.
    """
    indexer = label_indexer().fit(rows)
    names = indexer.labels
    *before, learner = (builder or BUILDERS[model])(features, len(names) + 1)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*names, "unknown"])
    if not _mergeable(learner):
        kept = weighted(rows).select("label", "weight", *features)
        kept = kept.repartition(_tasks(rows.count())).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return Pipeline(stages=[indexer, *before, learner, back]).fit(kept)
        finally:
            kept.unpersist()
    prepared = Pipeline(stages=[indexer, *before]).fit(rows.filter(F.col("label").isNotNull()).select("label", *features))
    table = counted(rows, features).select("label", "n", "weight", *features)
    table = in_pieces(table) if _draws(learner) else table
    # Lost blocks are recomputed from the input; the order inside a task is fixed, as draws go by it.
    order = ["label", *features, *(["_piece"] if _draws(learner) else [])]
    size = table.persist(StorageLevel.MEMORY_AND_DISK).count()
    kept = table.repartition(_tasks(size), *order).sortWithinPartitions(*order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if _perceptron(learner):
            return PipelineModel([*prepared.stages, fit_perceptron(learner, prepared.transform(kept), "n"), back])
        if not learner.isDefined(learner.weightCol):
            learner = learner.copy({learner.weightCol: "n"})
        if boosting.follows(learner) and size <= boosting.MOST_ROWS:
            return PipelineModel([*prepared.stages, boosting.fit(learner, prepared.transform(kept), len(names)), back])
        learner = _same_penalty(learner, kept)
        return PipelineModel([*prepared.stages, learner.fit(prepared.transform(kept)), back])
    finally:
        kept.unpersist()
        table.unpersist()


def _tasks(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_TASK))


def predict(fitted: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("event_id", "label")) -> DataFrame:
    return fitted.transform(rows).select(*keep, "predicted")


def experiment(
    rows: DataFrame,
    *,
    models: Sequence[str] = tuple(BUILDERS),
    feature_sets: Sequence[str] = tuple(FEATURE_SETS),
    folds: int = 5,
    splits: Sequence[str] = ("grouped_cv", *evaluate.CROSS_SPLITS),
    builders=None,
    parallel: int = 5,
) -> DataFrame:
    """Predictions of every (feature set, model, split).

    The grid is small; each fit and prediction is a distributed job, and ``parallel`` fits run at a time.  A
    cross-protocol split without rows on either side is left out.
    """
    builders = builders or BUILDERS
    unknown = (set(models) - set(builders)) | (set(feature_sets) - set(FEATURE_SETS))
    if unknown:
        raise ValueError(f"unknown models or feature sets: {sorted(unknown)}")
    foldable = evaluate.with_folds(rows, folds)
    # One row per fold and protocol tells which splits have rows on both sides.
    present = foldable.select("fold", "protocol").distinct().collect()
    used_folds, protocols = {r["fold"] for r in present}, {r["protocol"] for r in present}
    cells: list[tuple] = []

    def add(*cell) -> None:
        cells.append(cell)

    def run(cell) -> DataFrame:
        train, test, fs, model, split, fold = cell
        fitted = fit(train, model, FEATURE_SETS[fs], builders[model])
        tags = {"feature_set": fs, "model": model, "split": split}
        out = predict(fitted, test).withColumns({k: F.lit(v) for k, v in tags.items()})
        return out.withColumn("fold", F.lit(fold).cast("int"))

    for fs in feature_sets:
        for model in models:
            for split in splits:
                if split == "grouped_cv":
                    for i in sorted(used_folds) if len(used_folds) > 1 else ():
                        add(foldable.filter(F.col("fold") != i), foldable.filter(F.col("fold") == i), fs, model, split, i)
                elif {"mqtt", "coap"} <= protocols:
                    train, test = evaluate.cross_split(rows, split)
                    add(train, test, fs, model, split, None)
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(run), cells))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attack_score(fitted: PipelineModel, mode: str = "not_benign") -> Column:
    """Anomaly score from class probabilities: ``1 - P(benign)``, or the largest output."""
    outputs = vector_to_array("probability")
    if mode == "max_proba":
        return score_from_outputs(outputs)
    labels = fitted.stages[0].labels
    return F.lit(1.0) - outputs[labels.index("benign")]


def score(fitted: PipelineModel, rows: DataFrame, mode: str = "not_benign") -> DataFrame:
    """Adds ``model_score``; feed it to ``detect.evaluate(..., model_score="model_score")``."""
    out = fitted.transform(rows)
    return out.withColumn("model_score", attack_score(fitted, mode)).select(*rows.columns, "model_score")


def _trees(stage: Model) -> list[Model]:
    return list(stage.models) if hasattr(stage, "models") else [stage]


def feature_importance(fitted: PipelineModel, features: Sequence[str] = FEATURES, top: int = 10) -> list[tuple[str, float]]:
    """Largest importances, averaged over the members of a one-against-rest model."""
    stage = next(s for s in fitted.stages if hasattr(s, "featureImportances") or hasattr(s, "models"))
    members = [m.featureImportances.toArray() for m in _trees(stage)]
    mean = sum(members) / len(members)
    return sorted(zip(features, map(float, mean)), key=lambda p: (-p[1], p[0]))[:top]


def save(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def size_bytes(spark, path: str) -> int:
    """Stored size of a model folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
