"""Rules, anomaly score, decision and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.functions.numeric import clamp01
from iotlens.settings import Detection

# Weights of the heuristic score.
RATE_WEIGHT = 0.65
SIZE_WEIGHT = 0.35
COAP_BONUS = 0.03

NEEDED_FEATURES = ["f00", "f02"]


def rule_list(settings: Detection) -> list[tuple[str, float, str]]:
    """Rules as data, first match wins: (feature, limit, reason)."""
    return [
        ("f00", settings.rate_rule, "rule:msg_rate_exceeded"),
        ("f02", settings.size_rule, "rule:oversized_payload"),
    ]


def rule_reason(settings: Detection = Detection(), rules: Sequence[tuple[str, float, str]] | None = None) -> Column:
    out = F.when(F.lit(False), "")
    for feature, limit, reason in rules or rule_list(settings):
        out = out.when(F.col(feature) >= limit, reason)
    return out.otherwise("")


def heuristic_score() -> Column:
    base = clamp01(F.col("f00") * RATE_WEIGHT + F.col("f02") * SIZE_WEIGHT)
    bonus = F.when(F.col("protocol") == "coap", COAP_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), base + bonus)


def predicted_label(score: Column, settings: Detection = Detection()) -> Column:
    return F.when(score >= settings.suspicious, "suspicious").otherwise("benign")


def decide(df: DataFrame, settings: Detection = Detection()) -> DataFrame:
    """Adds ``allow``, ``action`` and ``reason`` from ``rule_reason`` and ``anomaly_score``."""
    ruled = F.col("rule_reason") != ""
    score = F.col("anomaly_score")
    action = (
        F.when(ruled, "drop")
        .when(score >= settings.drop, "drop")
        .when(score >= settings.rate_limit, "rate_limit")
        .otherwise("forward")
    )
    reason = (
        F.when(ruled, F.col("rule_reason"))
        .when(score >= settings.drop, "inference:high_anomaly_score")
        .when(score >= settings.rate_limit, "inference:elevated_anomaly_score")
        .otherwise("")
    )
    return df.select("*", action.alias("action"), reason.alias("reason")).withColumn(
        "allow", F.col("action") != "drop"
    )


def evaluate(vectors: DataFrame, settings: Detection = Detection(), model_score: str | None = None) -> DataFrame:
    """Rules, score, label and decision for rows that carry ``f00``, ``f02`` and ``protocol``.

    ``model_score`` names a column with a model's score; where it is null or negative the
    heuristic is used.
    """
    score = heuristic_score()
    if model_score:
        m = F.col(model_score)
        score = F.coalesce(F.when(m >= 0, m), score)
    scored = vectors.select("*", rule_reason(settings).alias("rule_reason"), score.alias("anomaly_score"))
    scored = scored.withColumn("predicted_label", predicted_label(F.col("anomaly_score"), settings))
    return decide(scored, settings)


def route(decided: DataFrame, *more: str) -> DataFrame:
    """One log of both outcomes: allowed rows as they are, denied rows as mitigation rows.

    A single pass; filter on ``direction`` for either part.  Columns named in ``more`` are carried along.
    """
    allowed = F.col("allow")
    return decided.select(
        "event_id", "t_us", "protocol", "source_id",
        F.when(allowed, F.col("direction")).otherwise("mitigation").alias("direction"),
        F.when(allowed, F.col("event")).otherwise(F.col("action")).alias("event"),
        "bytes",
        F.when(allowed, F.col("detail")).otherwise(F.col("reason")).alias("detail"), *more,
    )


def settings_columns(settings: Detection = Detection()) -> dict[str, Column]:
    """Effective thresholds as constant columns, to stand next to any result."""
    return {
        "rule_msg_rate": F.lit(settings.rate_rule),
        "rule_payload": F.lit(settings.size_rule),
        "infer_rate_limit": F.lit(settings.rate_limit),
        "infer_drop": F.lit(settings.drop),
    }


def settings_table(spark, settings: Detection = Detection(), model: bool = False) -> DataFrame:
    return spark.range(1).select(
        F.lit(model).alias("model"), *[c.alias(n) for n, c in settings_columns(settings).items()]
    )
