"""Summaries make the rows they summarise once."""

from __future__ import annotations

from pyspark.sql import functions as F

from iotlens.operators import quality


def test_summary_makes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    rows = spark.range(500).select(watched((F.col("id") % 5).cast("double")).alias("f00"))
    got = quality.feature_summary(rows, features=["f00"]).collect()
    assert [(r["feature"], r["count"], r["median"]) for r in got] == [("f00", 500, 2.0)]
    assert seen.value == 500
