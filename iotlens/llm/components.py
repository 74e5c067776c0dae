"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotlens.llm.common import stored


def components(edges: DataFrame, name: str, rounds: int = 200) -> DataFrame:
    """``node, least``: the smallest node reachable from each node with an edge ``a, b``; that smallest node itself has no row.

    Large-star hangs what lies above a node under its smallest neighbour, small-star what lies below; both keep components, and
    rounds end when nothing changes.  The number of rounds grows with the logarithm of the longest path; if ``rounds`` didn't
    do, it raises and gives no unfinished answer.  Repeated edges, loops, and an empty table are fine.
    """
    edges = stored(edges.select("a", "b").distinct(), name)
    before = None
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        raised = both.filter(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = raised.groupBy("a").agg(F.min("b").alias("m"))
        joined = raised.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        edges = stored(joined.unionByName(lows.select("a", F.col("m").alias("b"))).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        before = now
    raise RuntimeError(f"components haven't settled after {rounds} rounds")
