"""Streams over tables stored as folders, responses without an id, and entropy of large batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from iotlens.functions.entropy import batch_entropy
from iotlens.plans import catalog
from iotlens.sources.fixture import packet_event_stream, packet_events
from iotlens.streaming.flows import response_stream, run_to_end, use_rocksdb


def drained(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_table_as_folder_gives_all_rows(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    rows = drained(packet_event_stream(spark, str(tmp_path)), "folder_events", tmp_path)
    assert len(rows) == packet_events(spark, small).count() > 0


def test_streams_over_files_in_mixed_order_give_the_rows_of_one_trigger(spark, small, tmp_path):
    for k in range(8):  # files out of time order; each has rows of the whole range
        spark.read.parquet(f"{small}/events.parquet").filter(f"event_id * 7919 % 1009 % 8 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_behavioral_vector", "stream_request_response"):
        run = catalog.entries()[name].run
        want = sorted(map(str, run(spark, small).collect()))
        got = sorted(map(str, run(spark, str(tmp_path), 1).collect()))  # one file a trigger
        assert got == want and len(want) > 0, (name, len(got), len(want))


def test_late_responses_are_flagged(spark, tmp_path):
    schema = "mid long, event_id long, t_us long, direction string, source_id string"
    for at, rows in enumerate(([(1, 1, 10, "incoming", "a"), (1, 3, 30, "incoming", "b")], [(1, 2, 20, "outgoing", "c"), (1, 4, 40, "outgoing", "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)
    use_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ends = lambda e: response_stream(stream, delay_us=100, closing=e)
    on_time, late = run_to_end(ends, spark.read.parquet(str(tmp_path / "in")).select("mid"), str(tmp_path / "whole"))
    assert sorted((r["event_id"], r["request_id"]) for r in on_time.collect()) == [(2, 1), (4, 3)] and late.count() == 0
    on_time, late = run_to_end(lambda e: response_stream(stream, closing=e), spark.range(1).select(F.lit(1).cast("long").alias("mid")), str(tmp_path / "none"))
    assert [(r["event_id"], r["request_id"]) for r in on_time.collect()] == [(4, 3)] and [r["event_id"] for r in late.collect()] == [2]


def test_responses_without_id_stay_unrouted(spark, tmp_path):
    rows = [(1, 1, 10, "incoming", "a"), (1, 2, 15, "outgoing", "b"), (None, 3, 20, "outgoing", "b"), (None, 4, 21, "incoming", "a")]
    schema = "mid long, event_id long, t_us long, direction string, source_id string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(response_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "loose_responses", tmp_path)
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted((r["event_id"], r["routed"]) for r in got) == [(2, True), (3, False)]


def test_entropy_of_long_and_many_payloads():
    rng = np.random.default_rng(3)
    data = [rng.integers(0, k % 255 + 1, n).astype(np.uint8).tobytes() for k, n in enumerate([1, 0, 700_000, 5, 300_000] + [64] * 5000)]

    def plain(b):
        c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        c = c[c > 0] / max(1, len(b))
        return -(c * np.log2(c)).sum() if len(b) else 0.0

    assert np.allclose(batch_entropy(pa.array(data, pa.binary())), [plain(b) for b in data])
