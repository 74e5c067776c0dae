"""Dataset quality: one-hot and range checks, feature summaries, histograms, divergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.functions import text as X
from iotlens.functions.numeric import clamp01
from iotlens.operators import ranks as R
from iotlens.operators.vectors import to_long
from iotlens.schemas import FEATURES, SHARED
from iotlens.session import stored

BINS = 20
EPSILON = 1e-12


def onehot_violations(rows: DataFrame) -> DataFrame:
    p, a, b = F.col("protocol"), F.col("f15"), F.col("f16")
    wrong = ((p == "mqtt") & ~((a == 1.0) & (b == 0.0))) | ((p == "coap") & ~((a == 0.0) & (b == 1.0)))
    return rows.agg(F.count_if(wrong).alias("violations"), F.count(F.lit(1)).alias("rows"))


def range_violations(rows: DataFrame, features: Sequence[str] = SHARED) -> DataFrame:
    """Values outside [0, 1] per feature; one partial aggregate per task."""
    outside = (F.col("value") < 0.0) | (F.col("value") > 1.0)
    return to_long(rows.select(*features), [], features).groupBy("feature").agg(
        F.count_if(outside).alias("out_of_range")
    )


def summary_columns(value: str = "value") -> dict[str, Column]:
    return {
        "count": F.max("total"),
        "min": F.min(value),
        "p25": R.linear(0.25, value),
        "median": R.linear(0.50, value),
        "p75": R.linear(0.75, value),
        "max": F.max(value),
        "mean": R.mean(value),
        "std": R.spread(value),
    }


def feature_summary(rows: DataFrame, by: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """Exact distribution summary per feature (and group), from value counts.

    The counts are written to the shared folder, so that the rows behind them are made once and not for each of their readers.
    """
    long = to_long(rows.select(*by, *features), list(by), features)
    counts = stored(R.value_counts(long, [*by, "feature"], "value"), "value-counts")
    return R.statistics_of_counts(counts, [*by, "feature"], "value", summary_columns(), few_groups=True)


def bin20(value) -> Column:
    """Bin of a clipped value; the last bin is closed."""
    return F.least(F.floor(clamp01(value) * BINS), F.lit(BINS - 1)).cast("int")


def histogram(rows: DataFrame, by: Sequence[str], features: Sequence[str] = SHARED) -> DataFrame:
    """Shares per (group, feature, bin) for non-empty bins, with the group's row count."""
    long = to_long(rows.select(*by, *features), list(by), features)
    counts = long.groupBy(*by, "feature", bin20("value").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by, "feature").agg(F.sum("n").alias("rows"))
    return counts.join(totals, [*by, "feature"]).withColumn("share", F.col("n") / F.col("rows"))


def kl_alignment(rows: DataFrame, features: Sequence[str] = SHARED) -> DataFrame:
    """Divergence between the protocols per attack class and feature.

    Both histograms of a (class, feature) fit one row per bin; bins empty on both sides add
    ``eps ln(1) = 0`` and need no row.  Classes seen in one protocol only are left out.
    """
    classed = rows.filter(F.col("protocol").isin("mqtt", "coap")).withColumn("attack_class", X.attack_class("label"))
    long = to_long(classed.select("attack_class", "protocol", *features), ["attack_class", "protocol"], features)

    def side(protocol: str) -> Column:
        return F.count_if(F.col("protocol") == protocol)

    bins = long.groupBy("attack_class", "feature", bin20("value").alias("bin")).agg(
        side("mqtt").alias("m"), side("coap").alias("c")
    )
    totals = bins.groupBy("attack_class", "feature").agg(F.sum("m").alias("mqtt_count"), F.sum("c").alias("coap_count"))
    totals = totals.filter((F.col("mqtt_count") > 0) & (F.col("coap_count") > 0))
    p = F.col("m") / F.col("mqtt_count") + EPSILON
    q = F.col("c") / F.col("coap_count") + EPSILON
    out = bins.join(totals, ["attack_class", "feature"]).groupBy("attack_class", "feature").agg(
        F.max("mqtt_count").alias("mqtt_count"),
        F.max("coap_count").alias("coap_count"),
        F.sum(p * F.log(p / q)).alias("kl_mqtt_to_coap"),
        F.sum(q * F.log(q / p)).alias("kl_coap_to_mqtt"),
    )
    return out.withColumn("kl_symmetric", (F.col("kl_mqtt_to_coap") + F.col("kl_coap_to_mqtt")) * 0.5)


def kl_by_class(alignment: DataFrame) -> DataFrame:
    return alignment.groupBy("attack_class").agg(F.avg("kl_symmetric").alias("mean_kl"))


# Classes that can appear in an alignment table.
CLASSES = ["benign", "flood", "other", "protocol_abuse", "wildcard"]


def kl_ranking(alignment: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Features by mean divergence over the classes that have one, with a column per class."""
    cols = [F.avg(F.when(F.col("attack_class") == c, F.col("kl_symmetric"))).alias(c) for c in classes]
    wide = alignment.groupBy("feature").agg(*cols)
    known = F.filter(F.array(*classes), lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    return wide.withColumn("mean_kl", mean).orderBy(F.desc("mean_kl"), "feature")
