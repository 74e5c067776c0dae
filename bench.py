"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Besides the query times it reports packets per second of the behavioral decision path
(windows, rules, score, action) on the whole table, and on a replica in which one source
sends a third of all packets, to show that cost per row stays flat under a hot key.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "source_actions",
    "decisions",
    "behavioral_vector",
    "legacy_vector",
    "dataset_rows",
    "mqtt_decode",
    "coap_decode",
    "request_response",
    "byte_entropy",
    "traffic_counters",
    "feature_summary",
    "kl_alignment",
    "drift",
    "score_distribution",
    "threshold_sweep",
    "mann_whitney",
    "fold_metrics",
]


def _timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)

    from pyspark.sql import functions as F

    from iotlens.operators import detect, vectors
    from iotlens.plans import catalog
    from iotlens.session import local_session
    from iotlens.sources.fixture import incoming, packet_events

    spark = local_session(cores, int(cores), "iotlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.entries()
    entries["capture_counts"].run(spark, sf_dir).collect()

    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        df = entries[name].run(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    def decided(events):
        return detect.evaluate(vectors.behavioral_vector(events))

    clients = incoming(packet_events(spark, sf_dir))
    rows = clients.count()
    plain = min(_timed(decided(clients)) for _ in range(2))
    copies = 4
    spread = clients.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    hot = spread.withColumns(
        {
            "source_id": F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.concat("source_id", F.lit("-"), F.col("copy"))),
            "protocol": F.when(F.col("event_id") % 3 == 0, F.lit("mqtt")).otherwise(F.col("protocol")),
            "event_id": F.col("event_id") * copies + F.col("copy"),
            "t_us": F.col("t_us") + F.col("copy") * 17,
        }
    ).drop("copy")
    hot_time = _timed(decided(hot))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "packets_per_s": round(rows / plain),
                "hot_source_packets_per_s": round(rows * copies / hot_time),
            }
        )
    )


if __name__ == "__main__":
    main()
