"""Drift between the stateless and the behavioral vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.schemas import FEATURES
from iotlens.sources.logs import event_tail

HIGH_DRIFT, MODERATE_DRIFT, OFF_DIAGONAL = 0.4, 0.2, 0.35


def _name(position: Column) -> Column:
    return F.concat(F.lit("f"), F.lpad(position.cast("string"), 2, "0"))


def drift(log: DataFrame) -> DataFrame:
    """Mean and spread of both vectors and of their distance, per feature."""
    pairs = log.select(F.posexplode(F.arrays_zip("legacy", "behavioral")).alias("position", "pair")).select(
        "position", F.col("pair.legacy").alias("legacy"), F.col("pair.behavioral").alias("behavioral")
    )
    distance = F.abs(F.col("behavioral") - F.col("legacy"))
    return pairs.groupBy("position").agg(
        F.avg("legacy").alias("legacy_mean"),
        F.stddev_pop("legacy").alias("legacy_std"),
        F.avg("behavioral").alias("behavioral_mean"),
        F.stddev_pop("behavioral").alias("behavioral_std"),
        F.avg(distance).alias("drift_mean"),
        F.max(distance).alias("drift_max"),
    ).select(_name(F.col("position")).alias("feature"), "*").drop("position")


def top_drift(drift_table: DataFrame, k: int = 5) -> DataFrame:
    return drift_table.orderBy(F.desc("drift_mean"), "feature").limit(k)


def drift_bands(drift_table: DataFrame) -> DataFrame:
    d = F.col("drift_mean")
    return drift_table.select(
        "feature",
        "drift_mean",
        F.when(d > HIGH_DRIFT, "high").when(d > MODERATE_DRIFT, "moderate").otherwise("low").alias("band"),
        (F.abs(F.col("legacy_mean") - F.col("behavioral_mean")) > OFF_DIAGONAL).alias("off_diagonal"),
    )


def row_drift(legacy="legacy", behavioral="behavioral") -> Column:
    """Mean absolute distance of the two vectors of one row."""
    gaps = F.zip_with(legacy, behavioral, lambda a, b: F.abs(a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / F.size(legacy)


def tail_drift(log: DataFrame, last: int = 10) -> DataFrame:
    """Mean row drift of the last rows."""
    tail = event_tail(log.select("t_us", "event_id", row_drift().alias("row_drift")), last)
    return tail.agg(F.coalesce(F.avg("row_drift"), F.lit(0.0)).alias("avg_delta"), F.count("row_drift").alias("samples"))


assert len(FEATURES) == 33
