"""How the work of window state is dealt out."""

from __future__ import annotations

from pyspark.sql import functions as F

from iotlens.operators import sliding, state


def test_window_state_is_not_folded_into_few_tasks(spark):
    assert sliding.LEAST_TASKS >= 64
    part = F.spark_partition_id().alias("part")
    events = spark.range(2000).select(
        F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("t_us"), F.lit("mqtt").alias("protocol"),
        F.concat(F.lit("s"), F.col("id") % 100).alias("source_id"), F.lit("traffic").alias("event"), F.lit(9).alias("bytes"), F.lit("|publish").alias("detail"))
    rows = state.source_state(events, ["n1"]).select("event_id", part).collect()
    assert len(rows) == 2000 and len({r["part"] for r in rows}) > 32
