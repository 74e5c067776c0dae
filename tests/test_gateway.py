"""Packets to log: batch, stream, and a hand-made capture with denied requests."""

from pyspark.sql import functions as F

from iotlens.operators import gateway
from iotlens.settings import Slots
from iotlens.sources import logs
from iotlens.sources.fixture import capture
from iotlens.streaming import flows

CAPTURE_DDL = "event_id long, t_us long, protocol string, endpoint string, direction string, payload binary"


def request(mid, size=0):
    return bytes.fromhex(f"4001{mid:04x}ff") + b"a" * size


def test_denied_requests_are_never_matched(spark, tmp_path):
    """A flood from one client: what the rate rule denies is mitigated, and answers to it stay inside."""
    second = 1_000_000
    rows = [(j, 10_000 * j, "coap", "10.0.0.1:5000", "incoming", request(j)) for j in range(30)]  # 30 within 0.3 s
    rows += [(100 + j, second + 10_000 * j, "coap", "backend", "outgoing", request(j)) for j in range(30)]
    rows += [(200, 3 * second, "coap", "backend", "outgoing", request(0)), (201, 3 * second, "coap", "backend", "outgoing", b"\x40\x01")]
    rows += [(300, 0, "mqtt", "10.0.0.2:1", "outgoing", bytes.fromhex("62020001"))]
    spark.createDataFrame(rows, CAPTURE_DDL).write.parquet(str(tmp_path / "capture"))
    packets = logs.read_capture(spark, str(tmp_path / "capture"))
    decided = gateway.decided_packets(packets).cache()
    denied = {r["event_id"] for r in decided.filter(~F.col("allow")).collect()}
    assert denied == set(range(18, 30))  # 19 of 20 a second reach the rule
    log = {r["event_id"]: r for r in gateway.packet_log(packets, decided).collect()}
    assert len(log) == len(rows)
    for j in range(30):
        assert log[j]["direction"] == ("mitigation" if j in denied else "incoming")
        assert log[100 + j]["direction"] == ("internal" if j in denied else "outgoing"), j
        assert log[100 + j]["source_id"] == (None if j in denied else "10.0.0.1:5000")
    assert log[200]["event"] == log[201]["event"] == "unrouted_response"  # answered before; no id
    assert log[300]["direction"] == "outgoing" and log[300]["detail"].startswith("broker_to_client|")
    slotted = gateway.packet_log(packets, gateway.decided_packets(packets, slots=Slots()))
    assert {r["event_id"]: r for r in slotted.collect()} == log
    logs.write_event_log(gateway.packet_log(packets, decided), str(tmp_path / "log"))
    assert logs.read_event_log(spark, str(tmp_path / "log")).count() == len(rows)


def test_empty_capture_gives_an_empty_log(spark):
    packets = spark.createDataFrame([], CAPTURE_DDL)
    assert gateway.packet_log(packets, gateway.decided_packets(packets)).count() == 0


def test_stream_of_packets_gives_the_log_of_the_batch(spark, small, tmp_path):
    packets = capture(spark, small)
    cuts = packets.approxQuantile("t_us", [0.25, 0.5, 0.75], 0.0)
    part = sum((F.col("t_us") > c).cast("int") for c in cuts)
    for k in range(4):
        packets.filter(part == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)
    flows.use_rocksdb(spark)
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = flows.run_to_table(flows.packet_log_stream(stream), str(tmp_path / "out"))
    want = gateway.packet_log(packets, gateway.decided_packets(packets))
    names = flows.LOG.fieldNames()
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    kinds = {r["direction"] for r in want.select("direction").distinct().collect()}
    assert {"incoming", "outgoing", "internal"} <= kinds


def test_log_keeps_quotes_backslashes_and_line_ends(spark, tmp_path):
    texts = ['say "no"', "back\\slash", "two\nlines\r\n", "tab\there", "\u0001", "", "caf\u00e9 \U0001f600"]
    rows = [(j, 1_000_000 * j, "mqtt", "s", "incoming", "traffic", 5, text) for j, text in enumerate(texts)]
    df = spark.createDataFrame(rows, flows.LOG)
    logs.write_event_log(df, str(tmp_path / "log"))
    assert sorted(r["detail"] for r in logs.read_event_log(spark, str(tmp_path / "log")).collect()) == sorted(texts)
