"""Byte-level goldens of packet decode."""

import pytest
from pyspark.sql import functions as F

from iotlens.operators import decode, walks
from iotlens.schemas import CAPTURE

MQTT = {
    "": "malform|empty",
    "101600044d5154540402003c000a7765656b372d74657374": "connect|client_id:week7-test|keepalive:60",
    "100d00044d5154540406003c000161": "connect|client_id:a|will|keepalive:60",
    "103f00044d5154540402003c000f7374726573735f636c69656e745f30": "connect|malform|client_id:stress_client_0|keepalive:60",
    "321e001373656e736f72732f74656d702f6f7574707574000176616c75655f30": "publish|qos:1|topic:sensors/temp/output",
    "31090006742f77696c6c78": "publish|qos:0|retain|topic:t/will",
    "820e0001000973656e736f72732f2301": "subscribe|wildcard",
    "82170001001273656e736f72732f74656d702f726f6f6d3001": "subscribe",
    "62020001": "pubrel",
    "c0": "pingreq|malform",
    "30ffffffff": "publish|malform|qos:0",
    "1000": "connect|keepalive:0",
    "f000": "unknown",
    "0000": "unknown",
    "820500010003612f": "subscribe",
}

COAP = {
    "400112": "malform|short_header",
    "40011234bb2e77656c6c2d6b6e6f776e04636f7265": "con|get|path:/.well-known/core|discovery|optcount:2",
    "40020001b3636d6405657866696cff5858": "con|post|path:/cmd/exfil|optcount:2",
    "400103e9c474656d70c6696e646f6f72": "con|get|optcount:2",
    "420100070abc60": "con|get|token:abc|observe|optcount:1",
    "40010008605173d10407": "con|get|path:/s|observe|optcount:3",
    "80010001": "con|get|malform",
    "49010001": "con|get|malform",
    "40010001f0": "con|get|malform",
    "60450001": "ack|code:69|optcount:0",
    "700000aa": "rst|code:0|optcount:0",
    "4001000141": "con|get|malform",
    "41010001": "con|get|malform",
    "4101000100d106": "con|get|token:0|malform",
    "40010001d10a41": "con|get|blockwise|optcount:1",
    "40010001e0000a": "con|get|optcount:1",
    "40010001b00161": "con|get|path:/a|optcount:2",
    "40010001b16100": "con|get|path:/a/|optcount:2",
}


def capture(spark, packets, protocol, direction="incoming"):
    rows = [(i, i, protocol, "10.0.0.9:5683", direction, bytes.fromhex(h)) for i, h in enumerate(packets)]
    return spark.createDataFrame(rows, CAPTURE)


def details(df):
    return [r["detail"] for r in df.orderBy("event_id").collect()]


def test_mqtt_goldens(spark):
    got = details(decode.mqtt_decode(capture(spark, MQTT, "mqtt")))
    assert got == ["client_to_broker|" + d for d in MQTT.values()]


def test_mqtt_sources(spark):
    rows = decode.mqtt_decode(capture(spark, MQTT, "mqtt")).orderBy("event_id").collect()
    assert [r["source_id"] for r in rows][:5] == ["mqtt-client", "week7-test", "a", "stress_client_0", "mqtt-client"]
    assert [r["event"] for r in rows][:5] == ["traffic"] + ["connection_open"] * 3 + ["traffic"]


def test_coap_goldens(spark):
    got = details(decode.coap_decode(capture(spark, COAP, "coap")))
    assert got == ["client_to_backend|" + d for d in COAP.values()]


def test_outgoing_routes(spark):
    got = details(decode.coap_decode(capture(spark, ["60450001"], "coap", "outgoing")))
    assert got == ["backend_to_client|ack|code:69|optcount:0"]


@pytest.mark.parametrize(
    "packet,frames",
    [("", 0), ("c0", 0), ("c000", 1), ("c000c000", 2), ("c000c0", 1), ("3003616263c000", 2), ("300561", 0),
     ("c00030ffffffff", 1), ("3080", 1), ("30" + "8001" + "61" * 128 + "c000", 2)],
)
def test_frame_counts(packet, frames):
    import pyarrow as pa

    rows, _ = walks.frame_ends(pa.array([bytes.fromhex(packet), b"\xc0\x00"], pa.binary()))
    assert list(rows).count(0) == frames
    assert list(rows).count(1) == 1


def frames_one_by_one(data: bytes) -> list[int]:
    """Plain restatement used as brute force."""
    ends, at = [], 0
    while at + 2 <= len(data):
        size, used, shift = 0, 0, 0
        while at + 1 + used < len(data):
            b = data[at + 1 + used]
            size, used, shift = size + ((b & 127) << shift), used + 1, shift + 7
            if b < 128:
                break
            if used == 4:
                return ends
        at += 1 + used + size
        if at > len(data):
            break
        ends.append(at)
    return ends


def test_frames_match_brute_force():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    packets = [bytes(rng.choice([0, 1, 2, 3, 127, 128, 130, 255], size=n).astype("uint8")) for n in rng.integers(0, 40, 600)]
    rows, ends = walks.frame_ends(pa.array(packets, pa.binary()))
    for i, p in enumerate(packets):
        assert list(ends[rows == i]) == frames_one_by_one(p)


def test_split_frames(spark):
    rows = decode.split_frames(capture(spark, ["c0003003616263"], "mqtt")).orderBy("frame_no").collect()
    assert [bytes(r["frame"]).hex() for r in rows] == ["c000", "3003616263"]


def test_payload_walk_ignores_slices(spark):
    import pyarrow as pa

    arr = pa.array([b"junk", bytes.fromhex("b161"), None, bytes.fromhex("60")], pa.binary())
    out = walks.option_walk(arr.slice(1)).to_pylist()
    assert [o["path"] for o in out] == ["a", "", ""]
    assert [o["observe"] for o in out] == [False, False, True]


def test_carry_client_id(spark):
    rows = [(1, 10, "c1", "traffic", "mqtt-client"), (2, 20, "c1", "connection_open", "dev"), (3, 7_200_000_000, "c1", "traffic", "mqtt-client"),
            (4, 30, "c2", "traffic", "mqtt-client")]
    df = spark.createDataFrame(rows, "event_id long, t_us long, endpoint string, event string, source_id string")
    out = {r["event_id"]: r["source_id"] for r in decode.carry_client_id(df).collect()}
    assert out == {1: "mqtt-client", 2: "dev", 3: "dev", 4: "mqtt-client"}


def test_message_id(spark):
    df = capture(spark, ["400103e9", "4001"], "coap").select(decode.message_id("payload").alias("m"), "event_id")
    assert [r["m"] for r in df.orderBy("event_id").collect()] == [1001, None]
    assert F.lit(1) is not None
