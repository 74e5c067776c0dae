"""Queries: packet decode and request/response correlation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from iotlens.operators import correlate, counters, decode, gateway
from iotlens.plans import oracle_base as B
from iotlens.plans.registry import register
from iotlens.session import shared_dir
from iotlens.settings import Slots
from iotlens.sources.fixture import capture, packet_events


def _mqtt(spark, sf):
    return capture(spark, sf).filter(F.col("protocol") == "mqtt")


def _coap(spark, sf):
    return capture(spark, sf).filter(F.col("protocol") == "coap")


_PACKET = (
    "CASE WHEN event_type = 'signup' THEN 'connect' WHEN event_type = 'purchase' AND k % 8 = 0 THEN 'subscribe' "
    "WHEN event_type = 'click' AND k % 20 = 0 THEN 'pubrel' ELSE 'publish' END"
)
_TOPIC_LEN = "length('site/' || (k % 4) || '/dev/' || (k % 9))"
_REMAINING = (
    f"CASE {_PACKET} WHEN 'connect' THEN 12 + length('dev-' || user_id) WHEN 'subscribe' THEN 29 WHEN 'pubrel' THEN 2 "
    f"ELSE 2 + {_TOPIC_LEN} + CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END + bytes + CASE WHEN event_type = 'error' THEN 9 ELSE 0 END END"
)


@register(
    "mqtt_header",
    B.WITH_EV + f"SELECT event_id, {_PACKET} AS packet, CAST({_REMAINING} AS BIGINT) AS remaining_length, "
    "event_type = 'error' AS malformed FROM ev WHERE protocol = 'mqtt'",
)
def mqtt_header(spark, sf):
    f = decode.mqtt_fields(_mqtt(spark, sf))
    return f.select("event_id", "packet", F.col("remaining_length").cast("long").alias("remaining_length"), "malformed")


@register(
    "mqtt_connect",
    B.WITH_EV + "SELECT event_id, 'dev-' || user_id AS client_id, k % 5 = 0 AS will, k * 5 AS keepalive FROM ev "
    "WHERE protocol = 'mqtt' AND event_type = 'signup'",
)
def mqtt_connect(spark, sf):
    f = decode.mqtt_fields(_mqtt(spark, sf)).filter(F.col("packet") == "connect")
    return f.select("event_id", "client_id", "will", "keepalive")


@register(
    "mqtt_publish",
    B.WITH_EV + f"SELECT event_id, k % 3 AS qos, (event_type <> 'error' AND k % 10 = 0) AS retain, 'site/' || (k % 4) || '/dev/' || (k % 9) AS topic "
    f"FROM ev WHERE protocol = 'mqtt' AND {_PACKET} = 'publish'",
)
def mqtt_publish(spark, sf):
    f = decode.mqtt_fields(_mqtt(spark, sf)).filter(F.col("packet") == "publish")
    return f.select("event_id", F.col("qos").cast("int").alias("qos"), "retain", "topic")


@register(
    "mqtt_decode",
    B.WITH_EV + "SELECT event_id, CASE WHEN event = 'connection_open' THEN 'dev-' || user_id ELSE 'mqtt-client' END AS source_id, event, "
    "detail FROM ev WHERE protocol = 'mqtt'",
)
def mqtt_decode(spark, sf):
    return decode.mqtt_decode(_mqtt(spark, sf)).select("event_id", "source_id", "event", "detail")


@register(
    "mqtt_named_sources",
    B.WITH_EV + "SELECT event_id, coalesce(last_value(CASE WHEN event = 'connection_open' THEN 'dev-' || user_id END IGNORE NULLS) OVER "
    "(PARTITION BY source_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'mqtt-client') AS source_id "
    "FROM ev WHERE protocol = 'mqtt'",
)
def mqtt_named_sources(spark, sf):
    events = decode.mqtt_decode(_mqtt(spark, sf)).drop("payload")
    return decode.carry_client_id(events).select("event_id", "source_id")


def _reads(spark, sf):
    """Several frames per read: 1 + k % 3 whole frames, and a cut one where k % 4 is 0.

    A faulty packet claims more bytes than its read holds, so it has no complete frame.
    """
    m = capture(spark, sf, "k", "event_type").filter(F.col("protocol") == "mqtt")
    hexed = F.hex("payload")
    cut = F.when(F.col("k") % 4 == 0, F.lit("30206162")).otherwise("")
    many = F.concat(F.repeat(hexed, F.when(F.col("event_type") == "error", 1).otherwise(F.col("k") % 3 + 1).cast("int")), cut)
    return m.select("event_id", F.unhex(many).alias("payload"))


@register(
    "mqtt_frames",
    B.WITH_EV + "SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + k % 3 END AS INTEGER) AS frames FROM ev WHERE protocol = 'mqtt'",
)
def mqtt_frames(spark, sf):
    return decode.mqtt_frames(_reads(spark, sf)).select("event_id", "frames")


@register(
    "mqtt_frame_split",
    B.WITH_EV + f"SELECT event_id, CAST(unnest(range(1 + k % 3)) AS INTEGER) AS frame_no, CAST(1 + CASE WHEN {_REMAINING} < 128 THEN 1 ELSE 2 END + {_REMAINING} AS INTEGER) AS frame_bytes "
    "FROM ev WHERE protocol = 'mqtt' AND event_type <> 'error'",
)
def mqtt_frame_split(spark, sf):
    return decode.split_frames(_reads(spark, sf)).select("event_id", "frame_no", F.octet_length("frame").alias("frame_bytes"))


_COAP_TYPE = "CASE WHEN event_type = 'error' THEN 'con' ELSE ['con','non','ack','rst'][k % 4 + 1] END"
_COAP_CODE = "CASE event_type WHEN 'error' THEN 'get' WHEN 'view' THEN 'get' WHEN 'click' THEN 'post' WHEN 'purchase' THEN 'put' ELSE 'delete' END"


@register(
    "coap_header",
    B.WITH_EV + f"SELECT event_id, {_COAP_TYPE} AS type, {_COAP_CODE} AS code, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS version, "
    "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS token_length, CASE WHEN event_type <> 'error' THEN CAST(k AS VARCHAR) END AS token, mid, "
    "event_type = 'error' AS bad_header FROM ev WHERE protocol = 'coap'",
)
def coap_header(spark, sf):
    h = decode.coap_header(_coap(spark, sf))
    return h.select(
        "event_id", "type", "code", "version", F.col("token_length").cast("int").alias("token_length"), "token",
        F.col("mid").cast("int").alias("mid"), "bad_header",
    )


_OPTIONS = "(4 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 IN (0, 1, 2) THEN 1 ELSE 0 END)"


@register(
    "coap_options",
    B.WITH_EV + f"SELECT event_id, 's/' || (k % 4) || '/r/' || (k % 7) AS path, k % 6 = 0 AS observe, k % 11 = 0 AS blockwise, {_OPTIONS} AS options "
    "FROM ev WHERE protocol = 'coap' AND event_type <> 'error'",
)
def coap_options(spark, sf):
    f = decode.coap_fields(_coap(spark, sf)).filter(~F.col("bad_header") & ~F.col("malformed"))
    return f.select("event_id", "path", "observe", "blockwise", "options")


@register(
    "coap_decode",
    B.WITH_EV + "SELECT event_id, source_id, event, regexp_replace(detail, 'optcount:[0-9]+', 'optcount:' || "
    f"{_OPTIONS}) AS detail, mid FROM ev WHERE protocol = 'coap'",
)
def coap_decode(spark, sf):
    return decode.coap_decode(_coap(spark, sf)).select(
        "event_id", "source_id", "event", "detail", F.col("mid").cast("int").alias("mid")
    )


@register(
    "route_rewrite",
    B.WITH_EV + "SELECT event_id, CASE WHEN starts_with(detail, 'client_to_backend|') THEN 'backend_to_client' || substr(detail, 18) "
    "ELSE 'backend_to_client|' || detail END AS detail FROM ev WHERE protocol = 'coap'",
)
def route_rewrite(spark, sf):
    ev = packet_events(spark, sf).drop("payload").filter(F.col("protocol") == "coap")
    return ev.select("event_id", decode.reroute("detail", "backend").alias("detail"))


_PREV = (
    "prev AS (SELECT *, lag(direction) OVER w AS prev_direction, lag(source_id) OVER w AS prev_source, lag(t_us) OVER w AS prev_us, "
    "lag(event_id) OVER w AS prev_id FROM ev WHERE protocol = 'coap' WINDOW w AS (PARTITION BY mid ORDER BY t_us, event_id)), "
    "resp AS (SELECT *, coalesce(prev_direction = 'incoming', false) AS routed FROM prev WHERE direction = 'outgoing')"
)
WITH_RESPONSES = B.WITH_EV + "," + _PREV


def responses(spark, sf):
    ev = packet_events(spark, sf).drop("payload").filter(F.col("protocol") == "coap")
    return correlate.route_responses(
        ev.select("event_id", "t_us", "protocol", "source_id", "direction", "event", "bytes", "detail", "mid", "src")
    )


@register(
    "request_response",
    WITH_RESPONSES + " SELECT event_id, mid, routed, CASE WHEN routed THEN prev_source END AS endpoint, "
    "CASE WHEN routed THEN prev_id END AS request_id, CASE WHEN routed THEN t_us - prev_us END AS latency_us FROM resp",
)
def request_response(spark, sf):
    return responses(spark, sf).select("event_id", "mid", "routed", "endpoint", "request_id", "latency_us")


@register(
    "response_log",
    WITH_RESPONSES + " SELECT event_id, t_us, protocol, CASE WHEN routed THEN direction ELSE 'internal' END AS direction, "
    "CASE WHEN routed THEN event ELSE 'unrouted_response' END AS event, bytes, "
    "CASE WHEN routed THEN detail ELSE 'missing message-id mapping' END AS detail FROM resp",
)
def response_log(spark, sf):
    return correlate.response_log(responses(spark, sf))


# ---- from packets to the log ----------------------------------------------------------------

# Size and text of every packet as its bytes have them, and the one source that MQTT clients share by default.
_PACKET_BYTES = (
    f"CASE WHEN protocol = 'mqtt' THEN 1 + CASE WHEN {_REMAINING} < 128 THEN 1 ELSE 2 END + {_REMAINING} "
    f"- CASE WHEN event_type = 'error' THEN 9 ELSE 0 END "
    "WHEN event_type = 'error' THEN 4 ELSE 14 + bytes + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 2 ELSE 0 END "
    "+ CASE WHEN k % 5 = 2 THEN 22 WHEN k % 5 IN (0, 1) THEN 3 ELSE 0 END END"
)
_SENT = B.EV.replace("ev AS (", "sent AS (") + f""", ev AS (
  SELECT * REPLACE (
    CASE WHEN protocol = 'coap' THEN source_id WHEN event = 'connection_open' THEN 'dev-' || user_id ELSE 'mqtt-client' END AS source_id,
    CAST({_PACKET_BYTES} AS BIGINT) AS bytes,
    CASE WHEN protocol = 'coap' THEN regexp_replace(detail, 'optcount:[0-9]+', 'optcount:' || {_OPTIONS}) ELSE detail END AS detail)
  FROM sent)"""
_DECIDED = B.WITH_SCORED.replace(B.EV, _SENT)
_ANSWERED = _DECIDED + """,
msgs AS (
  SELECT event_id, t_us, source_id, direction, event, bytes, detail, mid FROM sc WHERE protocol = 'coap' AND allow
  UNION ALL SELECT event_id, t_us, source_id, direction, event, bytes, detail, mid FROM ev WHERE protocol = 'coap' AND direction = 'outgoing'),
prev AS (
  SELECT *, lag(direction) OVER w AS prev_direction, lag(source_id) OVER w AS prev_source, lag(t_us) OVER w AS prev_us, lag(event_id) OVER w AS prev_id
  FROM msgs WINDOW w AS (PARTITION BY mid ORDER BY t_us, event_id)),
resp AS (SELECT *, coalesce(prev_direction = 'incoming', false) AS routed FROM prev WHERE direction = 'outgoing')
"""


def _decided(spark, sf, write=True):
    """Decisions over the binary capture; all MQTT packets are one source, so its windows go by slot.  Written once for their readers."""
    packets = capture(spark, sf)
    rows = gateway.decided_packets(packets, slots=Slots())
    if write:
        folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        rows = spark.read.schema(rows.schema).parquet(folder)
    return packets, rows


@register(
    "capture_to_log",
    _ANSWERED + "SELECT event_id, t_us, protocol, source_id, CASE WHEN allow THEN direction ELSE 'mitigation' END AS direction, "
    "CASE WHEN allow THEN event ELSE action END AS event, bytes, CASE WHEN allow THEN detail ELSE reason END AS detail FROM sc "
    "UNION ALL SELECT event_id, t_us, protocol, source_id, direction, event, bytes, detail FROM ev WHERE protocol = 'mqtt' AND direction = 'outgoing' "
    "UNION ALL SELECT event_id, t_us, 'coap', CASE WHEN routed THEN prev_source END, CASE WHEN routed THEN direction ELSE 'internal' END, "
    "CASE WHEN routed THEN event ELSE 'unrouted_response' END, bytes, CASE WHEN routed THEN detail ELSE 'missing message-id mapping' END FROM resp",
)
def capture_to_log(spark, sf):
    """Binary packets to the whole log: decode, windows, decision, matching of allowed requests."""
    return gateway.packet_log(*_decided(spark, sf))


@register(
    "allowed_request_response",
    _ANSWERED + "SELECT event_id, mid, routed, CASE WHEN routed THEN prev_source END AS endpoint, CASE WHEN routed THEN prev_id END AS request_id, "
    "CASE WHEN routed THEN t_us - prev_us END AS latency_us FROM resp",
)
def allowed_request_response(spark, sf):
    """Responses by message id where denied requests never enter the map."""
    out = gateway.responses(*_decided(spark, sf))
    return out.select("event_id", F.col("mid").cast("int").alias("mid"), "routed", "endpoint", "request_id", "latency_us")


@register(
    "capture_counters",
    _DECIDED + "SELECT CAST(coalesce(sum(CASE WHEN allow AND protocol = 'mqtt' AND event_type <> 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS mqtt_msgs, "
    "CAST(coalesce(sum(CASE WHEN allow AND protocol = 'coap' THEN 1 ELSE 0 END), 0) AS BIGINT) AS coap_msgs, "
    "CAST(coalesce(sum(CASE WHEN allow THEN 0 ELSE 1 END), 0) AS BIGINT) AS detections FROM sc",
)
def capture_counters(spark, sf):
    """Complete frames of allowed MQTT packets, allowed CoAP packets and denied packets, from the bytes."""
    return counters.traffic_counters(_decided(spark, sf, write=False)[1])
