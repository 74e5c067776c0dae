"""Leak-free evaluation: folds, splits, confusion counts and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotlens.schemas import LABELS

CROSS_SPLITS = {"cross_mqtt_to_coap": ("mqtt", "coap"), "cross_coap_to_mqtt": ("coap", "mqtt")}


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weight ``n / (k count)`` per label."""
    return balanced_weights(rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")))


def balanced_weights(counts: DataFrame) -> DataFrame:
    """The weights from a table of one row per label with its number of ``rows``."""
    every = Window.partitionBy(F.lit(1))
    weight = F.sum("rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("rows"))
    return counts.select("label", "rows", weight.alias("weight"))


def group_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Fold of every run: runs are never split and labels are spread over the folds.

    Runs are dealt per dominant label, largest first, back and forth over the folds.  Only
    the run table (one row per run) is ranked.
    """
    per = rows.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))
    runs = per.groupBy("run_id").agg(
        F.max_by("label", F.struct("n", "label")).alias("label"), F.sum("n").alias("rows")
    )
    order = Window.partitionBy("label").orderBy(F.desc("rows"), F.md5(F.col("run_id").cast("binary")))
    place = F.row_number().over(order) - 1
    lap, step = F.floor(place / folds), place % folds
    fold = F.when(lap % 2 == 0, step).otherwise(folds - 1 - step)
    return runs.select("run_id", "label", "rows", fold.cast("int").alias("fold"))


def with_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Rows with their run's fold."""
    return rows.join(group_folds(rows, folds).select("run_id", "fold"), "run_id")


def cross_split(rows: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a cross-protocol split."""
    train, test = CROSS_SPLITS[split]
    return rows.filter(F.col("protocol") == train), rows.filter(F.col("protocol") == test)


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (true label, predicted label)."""
    return predictions.groupBy(*by, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label seen as true or predicted; 0 where undefined.

    Works on confusion counts: each cell adds to its true and to its predicted label.
    """
    n, hit = F.col("n"), F.col("label") == F.col("predicted")
    sides = F.array(
        F.struct(F.col("label").alias("l"), n.alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(hit, n).otherwise(0).cast("long").alias("hits")),
        F.struct(F.col("predicted").alias("l"), F.lit(0).cast("long").alias("support"), n.alias("guessed"), F.lit(0).cast("long").alias("hits")),
    )
    sums = counts.select(*by, F.inline(sides)).groupBy(*by, F.col("l").alias("label")).agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )
    hits, support, guessed = F.col("hits"), F.col("support"), F.col("guessed")
    return sums.select(
        *by, "label",
        _ratio(hits, guessed).alias("precision"),
        _ratio(hits, support).alias("recall"),
        _ratio(hits * 2.0, guessed + support).alias("f1"),
        "support",
        "hits",
    )


def overall(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1 (mean over labels) and support-weighted F1."""
    total = F.sum("support")
    return classes.groupBy(*by).agg(
        (F.sum("hits") / total).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"),
    )


METRICS = ["accuracy", "f1_macro", "f1_weighted"]


def metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return overall(per_class(confusion(predictions, by), by), by)


def fold_average(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the fold metrics; ``predictions`` carry ``fold``."""
    per_fold = metrics(predictions, [*by, "fold"])
    return per_fold.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS])


def evaluate_splits(predictions: DataFrame) -> DataFrame:
    """One row per (feature_set, model, split): fold means for grouped_cv, plain metrics for the rest.

    Rows of splits without folds carry fold 0, so one plan serves both.
    """
    keys = ["feature_set", "model", "split"]
    return fold_average(predictions.withColumn("fold", F.coalesce("fold", F.lit(0))), keys)


def ordered_results(results: DataFrame) -> DataFrame:
    return results.orderBy("split", F.desc("f1_macro"), F.desc("accuracy"))


def comparison_table(results: DataFrame, feature_sets: Sequence[str] = ("full", "normalized_plus_pid")) -> DataFrame:
    """Grouped-CV metrics by model and feature set; missing cells are 0."""
    cv = results.filter(F.col("split") == "grouped_cv")
    cells = {
        f"{m}_{fs}": F.coalesce(F.max(F.when(F.col("feature_set") == fs, F.col(m))), F.lit(0.0))
        for m in ("f1_macro", "f1_weighted", "accuracy")
        for fs in feature_sets
    }
    return cv.groupBy("model").agg(*[c.alias(n) for n, c in cells.items()])


def generalization_matrix(results: DataFrame, feature_set: str = "full") -> DataFrame:
    """Model by split for both F1 scores (4 places), with the gap to the worse cross split."""
    rows = results.filter(F.col("feature_set") == feature_set)
    splits = ["grouped_cv", *CROSS_SPLITS]

    def at(metric: str, split: str) -> Column:
        return F.round(F.max(F.when(F.col("split") == split, F.col(metric))), 4)

    wide = rows.groupBy("model").agg(
        *[at(m, s).alias(f"{m}_{s}") for m in ("f1_macro", "f1_weighted") for s in splits]
    )
    for m in ("f1_macro", "f1_weighted"):
        worst = F.least(*[F.col(f"{m}_{s}") for s in CROSS_SPLITS])
        wide = wide.withColumn(f"{m}_gap", F.col(f"{m}_grouped_cv") - worst)
    return wide


def champion_classes(spark, classes: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per-class table of one model in fixed label order; labels it never met are 0."""
    spine = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "position int, label string")
    joined = spine.join(classes.select("label", "precision", "recall", "f1"), "label", "left")
    return joined.na.fill(0.0, ["precision", "recall", "f1"])


def agreement(a: DataFrame, b: DataFrame, key: str = "event_id") -> DataFrame:
    """Share of equal predictions of two models, their metrics and the status.

    ``a`` and ``b``: key, ``label``, ``predicted``.
    """
    both = a.select(key, "label", F.col("predicted").alias("one")).join(b.select(key, F.col("predicted").alias("two")), key)
    cells = both.groupBy("label", "one", "two").agg(F.count(F.lit(1)).alias("n"))
    same = cells.agg(
        F.sum("n").alias("validation_samples"),
        (F.sum(F.when(F.col("one") == F.col("two"), F.col("n")).otherwise(0)) / F.sum("n")).alias("prediction_agreement"),
    )

    def scored(side: str, name: str) -> DataFrame:
        m = overall(per_class(cells.select("label", F.col(side).alias("predicted"), "n")))
        return m.select(F.col("accuracy").alias(f"accuracy_{name}"), F.col("f1_macro").alias(f"f1_macro_{name}"))

    one = F.lit(1)
    joined = same.withColumn("_k", one)
    for side, name in (("one", "original"), ("two", "other")):
        joined = joined.join(scored(side, name).withColumn("_k", one), "_k")
    share = F.col("prediction_agreement")
    return joined.select(
        "validation_samples", "prediction_agreement", "accuracy_original", "accuracy_other",
        F.abs(F.col("accuracy_original") - F.col("accuracy_other")).alias("accuracy_delta"),
        "f1_macro_original", "f1_macro_other",
        F.abs(F.col("f1_macro_original") - F.col("f1_macro_other")).alias("f1_macro_delta"),
        F.when(share > 0.99, "PASS").when(share > 0.95, "WARN").otherwise("FAIL").alias("status"),
    )


def validation_sample(rows: DataFrame, least: int = 1000, share: int = 5, key: str = "event_id", seed: int = 42) -> DataFrame:
    """Seeded sample without replacement of ``max(least, n // share)`` rows: those with the smallest keyed digests.

    Rows are counted by digest prefix.  Prefixes below the one in which the sample ends are taken
    whole, and only that one's rows are put in order, so no task sorts the sample.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    marked = rows.withColumn("_digest", digest).withColumn("_prefix", F.substring("_digest", 1, 4))
    # At most 65,536 prefixes, whatever the number of rows.
    order = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(order))
    size = F.greatest(F.lit(least), F.floor(F.sum("_n").over(Window.partitionBy()) / share))
    open_prefixes = counted.withColumn("_left", size - (F.col("_upto") - F.col("_n"))).filter("_left > 0").select("_prefix", "_n", "_left")
    reached = marked.join(open_prefixes, "_prefix")
    whole = reached.filter(F.col("_n") <= F.col("_left"))
    inside = Window.partitionBy("_prefix").orderBy("_digest", key)
    partly = reached.filter(F.col("_n") > F.col("_left")).withColumn("_place", F.row_number().over(inside))
    partly = partly.filter(F.col("_place") <= F.col("_left"))
    return whole.select(*rows.columns).unionByName(partly.select(*rows.columns))
