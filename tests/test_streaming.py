"""Stream results equal batch results."""

import pytest
from pyspark.sql import functions as F

from iotlens.operators import correlate, detect, state, vectors
from iotlens.schemas import FEATURES
from iotlens.sources.fixture import incoming, packet_events
from iotlens.sources import logs
from iotlens.streaming import flows
from iotlens.streaming import state_stream as SS


@pytest.fixture(scope="module")
def staged(spark, small, tmp_path_factory):
    """Canonical events written as several files in time order."""
    flows.use_rocksdb(spark)
    ev = packet_events(spark, small)
    out = str(tmp_path_factory.mktemp("events"))
    rows = ev.withColumn("part", F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("t_us", "event_id")))
    for i in range(1, 5):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(out)
    return out, ev


def run_to_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_behavioral_stream_equals_batch(spark, staged):
    path, ev = staged
    stream = flows.read_table_stream(spark, path, ev.schema, files_per_trigger=1)
    run_to_memory(SS.behavioral_stream(incoming(stream)), "feat")
    got = {r["event_id"]: r for r in spark.table("feat").collect()}
    want = vectors.behavioral_vector(incoming(ev)).select("event_id", *FEATURES).collect()
    assert len(got) == len(want) > 0
    for r in want:
        for f in FEATURES:
            assert got[r["event_id"]][f] == pytest.approx(r[f], abs=1e-9), (r["event_id"], f)


def test_late_rows_are_flagged(spark, staged, tmp_path):
    path, ev = staged
    src = str(tmp_path / "late")
    rows = incoming(ev).orderBy(F.desc("t_us")).limit(50)
    order = rows.orderBy("t_us", "event_id").collect()
    keep = {r["event_id"] for r in order[::5]}
    later = spark.createDataFrame([r for r in order if r["event_id"] not in keep], ev.schema)
    early = spark.createDataFrame([r for r in order if r["event_id"] in keep], ev.schema)
    later.coalesce(1).write.mode("append").parquet(src)
    __import__("time").sleep(1.1)
    early.coalesce(1).write.mode("append").parquet(src)
    stream = flows.read_table_stream(spark, src, ev.schema, files_per_trigger=1)
    run_to_memory(SS.source_state_stream(stream), "late_rows")
    out = spark.table("late_rows")
    assert out.count() == 50
    assert out.filter("late").count() > 0
    assert out.filter("late and n1 is not null").count() == 0


def test_responses_stream_equals_batch(spark, staged):
    path, ev = staged
    coap = ev.filter(F.col("protocol") == "coap")
    stream = flows.read_table_stream(spark, path, ev.schema, files_per_trigger=1).filter(F.col("protocol") == "coap")
    run_to_memory(flows.response_stream(stream), "resp")
    pick = ["event_id", "routed", "endpoint", "request_id", "latency_us"]
    want = correlate.route_responses(coap.drop("payload")).select(*pick)
    got = spark.table("resp").select(*pick)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_routing_and_counters(spark, staged, tmp_path):
    path, ev = staged
    stream = flows.read_table_stream(spark, path, ev.schema, files_per_trigger=2)
    feats = vectors.legacy_vector(incoming(stream).drop("payload"), detect.NEEDED_FEATURES)
    a, b, ck = (str(tmp_path / n) for n in ("allowed", "denied", "ck"))
    flows.route_stream(feats, a, b, ck, availableNow=True).awaitTermination(120)
    n = incoming(ev).count()
    assert spark.read.parquet(a).count() + spark.read.parquet(b).count() == n
    decided = detect.evaluate(feats).withColumn("frames", F.lit(1))
    flows.counter_stream(decided, str(tmp_path / "snap"), str(tmp_path / "ck2"), availableNow=True).awaitTermination(120)
    row = spark.read.json(str(tmp_path / "snap")).first()
    assert row["mqtt_msgs"] + row["coap_msgs"] + row["detections"] == n


def test_snapshot_has_the_live_percentile_and_always_one_version(spark, tmp_path):
    schema = "protocol string, allow boolean, frames int, latency_us long"
    values = []
    for k in range(3):  # one file a trigger
        own = [("mqtt", j % 5 > 0, 1, None if j % 7 == 0 else 1000 * (k * 400 + j)) for j in range(400)]
        values += [v for *_, v in own if v is not None]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.counter_stream(stream, str(tmp_path / "snap"), str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    row = logs.read_snapshot(spark, str(tmp_path / "snap")).first()
    want = sorted(values)[int(0.95 * len(values))] // 1000
    assert abs(row["latency_ms_p95"] - want) <= 2 and row["mqtt_msgs"] + row["detections"] == 1200
    assert logs._versions(spark, str(tmp_path / "snap")) == [2]
    logs.write_version(spark.createDataFrame([(7,)], "mqtt_msgs long"), str(tmp_path / "snap"), 3)
    (tmp_path / "snap" / "version=4").mkdir()  # begun, but not whole
    assert logs.read_snapshot(spark, str(tmp_path / "snap")).first()["mqtt_msgs"] == 7
    assert logs.read_snapshot(spark, str(tmp_path / "none")).first()["latency_ms_p95"] == 0


def test_windowed_counts_close(spark, staged):
    path, ev = staged
    stream = flows.read_table_stream(spark, path, ev.schema, files_per_trigger=1)
    run_to_memory(flows.windowed_counts(stream, "1 second"), "wc")
    total = spark.table("wc").agg(F.sum("messages")).first()[0]
    assert 0 < total <= ev.count()


def test_state_columns_match_names():
    assert set(SS.WIDTHS) | {"gap_ms", "start_us", "resources10"} == set(state.ALL)
