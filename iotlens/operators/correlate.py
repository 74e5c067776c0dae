"""Request/response correlation by message id.

A response belongs to the latest unanswered request with its message id: a later request
replaces an earlier one, and a match uses the request up.  So in arrival order per id a
response matches exactly when the row just before it is a request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotlens.operators.sliding import ROW, SEED
from iotlens.settings import SECOND_US

HOUR_US = 3600 * SECOND_US


def previous_row(
    df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], facts: Column, bucket_us: int = HOUR_US
) -> DataFrame:
    """Adds ``previous``: ``facts`` (a struct) of the row before, per key in (t, order).

    Keys are split into time buckets, so one message id with a third of the traffic runs in
    many tasks; the last row of the previous non-empty bucket comes in as a seed row.
    """
    rows = df.select("*", facts.alias("_facts"), F.expr(f"{t} div {bucket_us}L").alias("_b"))
    last = rows.groupBy(*keys, "_b").agg(F.max_by("_facts", F.struct(t, *order)).alias("_facts"))
    before = Window.partitionBy(*keys).orderBy("_b")
    seeds = last.select(*keys, "_b", F.lag("_facts").over(before).alias("_facts")).filter(F.col("_facts").isNotNull())
    both = rows.withColumn("_kind", F.lit(ROW)).unionByName(
        seeds.withColumn("_kind", F.lit(SEED)), allowMissingColumns=True
    )
    # A seed has null time and order columns, which sort first inside its bucket.
    w = Window.partitionBy(*keys, "_b").orderBy(t, *order)
    return (
        both.withColumn("previous", F.lag("_facts").over(w))
        .filter(F.col("_kind") == ROW)
        .drop("_facts", "_b", "_kind")
    )


def last_known(
    df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], value: str, bucket_us: int = HOUR_US
) -> DataFrame:
    """Fills ``value`` with its latest non-null at or before each row, per key in (t, order).

    Split into time buckets like :func:`previous_row`; the value known at the end of the
    earlier buckets comes in as a seed row.
    """
    rows = df.select("*", F.expr(f"{t} div {bucket_us}L").alias("_b"), F.lit(ROW).alias("_kind"))
    ends = rows.filter(F.col(value).isNotNull()).groupBy(*keys, "_b").agg(
        F.max_by(value, F.struct(t, *order)).alias(value)
    )
    places = rows.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    seeds = places.select(
        *keys, "_b", F.lit(SEED).alias("_kind"), F.last(value, ignorenulls=True).over(earlier).alias(value)
    ).filter(F.col(value).isNotNull())
    w = Window.partitionBy(*keys, "_b").orderBy(t, *order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(seeds, allowMissingColumns=True)
    return (
        both.withColumn(value, F.last(value, ignorenulls=True).over(w))
        .filter(F.col("_kind") == ROW)
        .select(*df.columns)
    )


def route_responses(messages: DataFrame, bucket_us: int = HOUR_US) -> DataFrame:
    """Responses with the endpoint of their request.

    ``messages``: allowed requests and all responses of one backend, with ``mid``,
    ``direction``, ``source_id`` (the client endpoint on requests), ``t_us``, ``event_id``.
    """
    facts = F.struct("direction", F.col("source_id").alias("endpoint"), F.col("t_us").alias("asked_us"), F.col("event_id").alias("request_id"))
    known = messages.filter(F.col("mid").isNotNull())
    ranked = previous_row(known, ["mid"], "t_us", ["event_id"], facts, bucket_us)
    matched = F.coalesce(F.col("previous.direction") == "incoming", F.lit(False))
    responses = ranked.filter(F.col("direction") == "outgoing").select(
        *messages.columns,
        matched.alias("routed"),
        F.when(matched, F.col("previous.endpoint")).alias("endpoint"),
        F.when(matched, F.col("previous.request_id")).alias("request_id"),
        F.when(matched, F.col("t_us") - F.col("previous.asked_us")).alias("latency_us"),
    )
    headless = messages.filter(F.col("mid").isNull() & (F.col("direction") == "outgoing")).select(
        *messages.columns,
        F.lit(False).alias("routed"),
        F.lit(None).cast("string").alias("endpoint"),
        F.lit(None).cast("long").alias("request_id"),
        F.lit(None).cast("long").alias("latency_us"),
    )
    return responses.unionByName(headless)


def response_log(responses: DataFrame, *more: str) -> DataFrame:
    """Log rows of responses: delivered ones stay outgoing, the rest are internal ``unrouted_response`` rows."""
    r = F.col("routed")
    return responses.select(
        *more, "event_id", "t_us", "protocol",
        F.when(r, F.col("direction")).otherwise("internal").alias("direction"),
        F.when(r, F.col("event")).otherwise("unrouted_response").alias("event"),
        "bytes",
        F.when(r, F.col("detail")).otherwise("missing message-id mapping").alias("detail"),
    )
