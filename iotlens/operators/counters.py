"""Traffic counters, coverage, latency and throughput summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotlens.functions.numeric import overhead
from iotlens.operators import ranks as R

SECONDS_PER_BLOCK = 3600


def counter_columns(frames: str = "frames") -> dict[str, Column]:
    allow = F.col("allow")
    mqtt, coap = F.col("protocol") == "mqtt", F.col("protocol") == "coap"

    def total(cond: Column, value) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")

    return {
        "mqtt_msgs": total(allow & mqtt, F.col(frames)),
        "coap_msgs": total(allow & coap, F.lit(1)),
        "detections": total(~allow, F.lit(1)),
    }


def traffic_counters(decided: DataFrame, frames: str = "frames") -> DataFrame:
    """Complete frames of allowed MQTT reads, allowed CoAP datagrams, denied packets."""
    return decided.agg(*[c.alias(n) for n, c in counter_columns(frames).items()])


def snapshots(decided: DataFrame, frames: str = "frames") -> DataFrame:
    """Cumulative counters at the end of every second that saw traffic.

    Seconds are summed first; running totals restart per hour and hours are joined by their
    own totals, so no window holds the whole timeline.
    """
    names = list(counter_columns(frames))
    second = F.expr("t_us div 1000000L")
    per_second = decided.groupBy(second.alias("second")).agg(*[c.alias(n) for n, c in counter_columns(frames).items()])
    per_second = per_second.withColumn("_block", F.expr(f"second div {SECONDS_PER_BLOCK}L"))
    # One row per hour of traffic.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_second.groupBy("_block").agg(*[F.sum(n).alias(n) for n in names]).select(
        "_block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in names]
    )
    inside = Window.partitionBy("_block").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    return per_second.join(blocks, "_block").select(
        "second", *[(F.sum(n).over(inside) + F.col(f"_{n}")).alias(n) for n in names]
    )


def feature_stats(scores: DataFrame) -> DataFrame:
    """Vector counts by protocol and score range; no scores give min 1 and max 0.

    ``scores``: ``protocol`` and ``score`` (null when a vector has no decision).
    """
    p = F.col("protocol")
    known = p.isin("mqtt", "coap")
    counts = scores.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.count_if(p == "mqtt").alias("mqtt"),
        F.count_if(p == "coap").alias("coap"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"),
        F.coalesce(F.min("score"), F.lit(1.0)).alias("min"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"),
    )
    p95 = R.order_statistics(scores, [], "score", {"p95": R.at_rank(R.ceil_rank(0.95), "score")})
    one = F.lit(1)
    return (
        counts.withColumn("_k", one)
        .join(p95.withColumn("_k", one), "_k", "left")
        .drop("_k")
        .withColumn("p95", F.coalesce("p95", F.lit(0.0)))
    )


def kpi_shares(counters: DataFrame) -> DataFrame:
    """Protocol shares and detection rate in percent of all messages; 0 when there are none."""
    total = F.col("mqtt_msgs") + F.col("coap_msgs")

    def share(value: Column) -> Column:
        return F.when(total > 0, value * 100.0 / total).otherwise(F.lit(0.0))

    return counters.select(
        total.alias("total_msgs"),
        share(F.col("mqtt_msgs")).alias("mqtt_pct"),
        share(F.col("coap_msgs")).alias("coap_pct"),
        share(F.col("detections")).alias("detection_pct"),
    )


def coverage(rows: DataFrame) -> DataFrame:
    """Row and run counts overall, by protocol and by label, in one pass."""
    sets = rows.groupingSets(
        [[F.col("protocol")], [F.col("label")], []], F.col("protocol"), F.col("label")
    ).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("run_id").alias("runs"), F.grouping_id().alias("_g"))
    # grouping_id bits: protocol, label; a set bit means the column is not part of the set.
    return sets.select(
        F.when(F.col("_g") == 1, "protocol").when(F.col("_g") == 2, "label").otherwise("all").alias("kind"),
        F.when(F.col("_g") == 1, F.col("protocol")).when(F.col("_g") == 2, F.col("label")).otherwise("all").alias("name"),
        "rows", "runs",
    )


def capture_counts(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("protocol") == "mqtt").alias("mqtt_rows"),
        F.count_if(F.col("protocol") == "coap").alias("coap_rows"),
        F.count_if(F.col("behavioral_enabled")).alias("behavioral_rows"),
        F.count_distinct("protocol").alias("protocols"),
    )


def latency_summary(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Samples, errors (null latency) and index-picked percentiles per group."""
    groups = groups or []
    stats = R.order_statistics(
        df, groups, value,
        {
            "samples": F.max("total"),
            "min": F.min(value),
            "p50": R.at_rank(F.floor(F.col("total") / 2), value),
            "p95": R.at_rank(R.floor_rank(0.95), value),
            "p99": R.at_rank(R.floor_rank(0.99), value),
            "max": F.max(value),
            "mean": R.mean(value),
        },
    )
    errors = df.groupBy(*groups).agg(F.count_if(F.col(value).isNull()).alias("errors"))
    if groups:
        return stats.join(errors, groups)
    return stats.withColumn("_k", F.lit(1)).join(errors.withColumn("_k", F.lit(1)), "_k").drop("_k")


def latency_linear(df: DataFrame, value: str) -> DataFrame:
    return R.order_statistics(
        df, [], value,
        {
            "mean": R.mean(value),
            "median": R.linear(0.5, value),
            "p95": R.linear(0.95, value),
            "p99": R.linear(0.99, value),
            "min": F.min(value),
            "max": F.max(value),
        },
    )


LATENCY_METRICS = ["min", "p50", "p95", "p99", "max", "mean"]


def path_overhead(direct: DataFrame, proxied: DataFrame) -> DataFrame:
    """Two latency summaries compared metric by metric."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        typed = df.select(*[F.col(m).cast("double").alias(m) for m in LATENCY_METRICS])
        return typed.unpivot([], LATENCY_METRICS, "metric", name)

    both = tall(direct, "direct_ms").join(tall(proxied, "proxy_ms"), "metric")
    diff, pct = overhead("direct_ms", "proxy_ms")
    return both.select("metric", "direct_ms", "proxy_ms", diff.alias("overhead_ms"), pct.alias("overhead_pct"))


def throughput(df: DataFrame, t: str = "t_us", failed: Column | None = None, value: str | None = None) -> DataFrame:
    """Totals, failures, elapsed seconds and mean rate; latency range when ``value`` is given."""
    failed = F.lit(False) if failed is None else failed
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(failed).alias("failures"),
        ((F.max(t) - F.min(t)) / 1e6).alias("elapsed_s"),
    ]
    if value:
        for fn in ("avg", "min", "max"):
            aggs.append(F.coalesce(getattr(F, fn)(value).cast("double"), F.lit(0.0)).alias(f"{fn}_latency"))
    out = df.agg(*aggs)
    rate = F.when(F.col("elapsed_s") > 0, F.col("total") / F.col("elapsed_s")).otherwise(F.lit(0.0))
    return out.withColumn("avg_rate", rate)


def rate_by_second(df: DataFrame, keys: list[str], t: str = "t_us") -> DataFrame:
    """Messages per second and key, with the change from the key's previous active second."""
    per = df.groupBy(*keys, F.expr(f"{t} div 1000000L").alias("second")).agg(F.count(F.lit(1)).alias("messages"))
    w = Window.partitionBy(*keys).orderBy("second")
    return per.withColumn("change", F.col("messages") - F.coalesce(F.lag("messages").over(w), F.lit(0)))
