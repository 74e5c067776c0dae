"""Anomaly score distributions.

``scores`` tables hold ``protocol`` and ``score``.  Everything works on value counts, so a
score shared by many rows is handled once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from iotlens.operators import ranks as R

FLAG_LIMIT, ELEVATED_LIMIT = 0.75, 0.30
BENIGN_ZONE = 0.40
SWEEP_FIRST, SWEEP_LAST, SWEEP_STEPS = 0.10, 0.95, 200
DENSITY_BINS = 29
KDE_POINTS, KDE_FACTOR, KDE_MIN_ROWS = 300, 0.3, 4


def with_all(scores: DataFrame) -> DataFrame:
    """Value counts per protocol plus the group ``all``."""
    counts = R.value_counts(scores, ["protocol"], "score")
    every = counts.groupBy("score").agg(F.sum("n").alias("n")).withColumn("protocol", F.lit("all"))
    return counts.unionByName(every)


def distribution(scores: DataFrame) -> DataFrame:
    ranked = R.cumulative(with_all(scores), ["protocol"], "score")
    return ranked.groupBy("protocol").agg(
        F.max("total").alias("count"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        R.mean("score").alias("mean"),
        R.linear(0.5, "score").alias("median"),
        R.spread("score", sample=True).alias("stdev"),
        R.at_rank(R.quarter_rank(1), "score").alias("p25"),
        R.at_rank(R.quarter_rank(3), "score").alias("p75"),
        R.at_rank(R.shifted_rank(0.95), "score").alias("p95"),
    )


def bands(scores: DataFrame) -> DataFrame:
    s = F.col("score")

    def share(cond: Column) -> Column:
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    return scores.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("count"),
        share(s < ELEVATED_LIMIT).alias("benign_ratio"),
        share((s >= ELEVATED_LIMIT) & (s < FLAG_LIMIT)).alias("elevated_ratio"),
        share(s >= FLAG_LIMIT).alias("suspicious_ratio"),
        F.avg("score").alias("anomaly_mean"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("anomaly_stdev"),
    )


def statistics(scores: DataFrame) -> DataFrame:
    ranked = R.cumulative(R.value_counts(scores, ["protocol"], "score"), ["protocol"], "score")
    flagged = F.sum(F.when(F.col("score") >= FLAG_LIMIT, F.col("n")).otherwise(0))
    return ranked.groupBy("protocol").agg(
        F.max("total").alias("n"),
        R.mean("score").alias("mean"),
        R.linear(0.5, "score").alias("median"),
        R.spread("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        R.linear(0.75, "score").alias("p75"),
        R.linear(0.95, "score").alias("p95"),
        flagged.alias("threshold_075_flagged"),
        (flagged / F.sum("n")).alias("threshold_075_rate"),
    )


def threshold_at(i: Column) -> Column:
    step = (SWEEP_LAST - SWEEP_FIRST) / (SWEEP_STEPS - 1)
    return F.lit(SWEEP_FIRST) + i * F.lit(step)


def threshold_sweep(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """Share of scores at or above each of 200 thresholds, and the same within the benign zone.

    Each score is placed once among the thresholds; suffix sums over the 200 places give all
    shares.
    """
    s = F.col("score")
    step = (SWEEP_LAST - SWEEP_FIRST) / (SWEEP_STEPS - 1)
    guess = F.greatest(F.lit(-1), F.least(F.lit(SWEEP_STEPS - 1), F.floor((s - SWEEP_FIRST) / step)))
    # The division may be off by one place at a threshold; compare with the neighbours.
    place = (
        F.when((guess + 1 < SWEEP_STEPS) & (threshold_at(guess + 1) <= s), guess + 1)
        .when((guess >= 0) & (threshold_at(guess) > s), guess - 1)
        .otherwise(guess)
    )
    zone = F.count_if(s < BENIGN_ZONE)
    counts = scores.groupBy(place.cast("long").alias("place")).agg(F.count(F.lit(1)).alias("n"), zone.alias("z"))
    # 201 rows at most from here on.
    grid = spark.range(-1, SWEEP_STEPS).withColumnRenamed("id", "place").join(counts, "place", "left").na.fill(0, ["n", "z"])
    above = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = grid.select(
        "place",
        (F.sum("n").over(above) / F.sum("n").over(everything)).alias("detection_rate"),
        F.when(F.sum("z").over(everything) > 0, F.sum("z").over(above) / F.sum("z").over(everything))
        .otherwise(F.lit(0.0))
        .alias("false_alarm_rate"),
    )
    return out.filter(F.col("place") >= 0).select(threshold_at(F.col("place")).alias("threshold"), "detection_rate", "false_alarm_rate")


def density(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """Normalised histogram on [0, 1] with 29 bins per protocol, empty bins included."""
    inside = scores.filter(F.col("score").between(0.0, 1.0))
    place = F.least(F.floor(F.col("score") * DENSITY_BINS), F.lit(DENSITY_BINS - 1))
    counts = inside.groupBy("protocol", place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("protocol").agg(F.sum("n").alias("rows"))
    spine = totals.select("protocol", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DENSITY_BINS - 1).cast("long"))).alias("bin"))
    joined = spine.join(counts, ["protocol", "bin"], "left")
    return joined.select("protocol", "bin", (F.coalesce("n", F.lit(0)) * DENSITY_BINS / F.col("rows")).alias("density"))


def kernel_density(scores: DataFrame) -> DataFrame:
    """Gaussian density on 300 points per protocol with more than three rows.

    Each distinct score adds its weight to the 300 points; the sums are combined before the
    shuffle, so at most 300 rows per protocol and task are moved.
    """
    counts = R.value_counts(scores, ["protocol"], "score")
    moments = scores.groupBy("protocol").agg(F.count("score").alias("rows"), F.stddev_samp("score").alias("sd"))
    usable = moments.filter((F.col("rows") >= KDE_MIN_ROWS) & (F.col("sd") > 0))
    rows = R.spread_out(counts.join(usable, "protocol")).select(
        "protocol", "score", "n", "rows", (F.col("sd") * KDE_FACTOR).alias("h"),
        F.explode(F.sequence(F.lit(0), F.lit(KDE_POINTS - 1))).alias("point"),
    )
    x = F.col("point") / float(KDE_POINTS - 1)
    z = (x - F.col("score")) / F.col("h")
    kernel = F.exp(z * z * -0.5) / (F.col("h") * math.sqrt(2.0 * math.pi))
    return rows.groupBy("protocol", "point").agg((F.sum(F.col("n") * kernel) / F.max("rows")).alias("density"))


def box_stats(scores: DataFrame) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 interquartile ranges, outlier count."""
    ranked = R.cumulative(R.value_counts(scores, ["protocol"], "score"), ["protocol"], "score")
    boxes = ranked.groupBy("protocol").agg(
        R.linear(0.25, "score").alias("q1"), R.linear(0.5, "score").alias("median"), R.linear(0.75, "score").alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("score").between(F.col("q1") - reach, F.col("q3") + reach)
    return ranked.select("protocol", "score", "n").join(boxes, "protocol").groupBy("protocol").agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("score"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("score"))).alias("high_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def caught(events: DataFrame, last: int, limit: float = FLAG_LIMIT) -> DataFrame:
    """How many of the last rows score above the limit (strictly)."""
    tail = events.orderBy(F.desc("t_us"), F.desc("event_id")).limit(last)
    return tail.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("anomaly_score") > limit).alias("caught"))
