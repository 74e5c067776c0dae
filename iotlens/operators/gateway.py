"""One path from binary packets to the log: decode, features, decision, matching of responses.

Client packets are decoded and decided on; denied ones become mitigation rows and go no further.  Allowed CoAP requests are the
only ones that a response can belong to, so the response to a denied request is an ``unrouted_response``.  Packets from the MQTT broker
are logged as they come.

``decided`` is read by three parts of the log.  Give a decision table that was written once (``sources.logs`` or parquet in a shared
folder) where the windows below it are expensive; a plan alone computes them once per part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotlens.operators import correlate, decode, detect, vectors
from iotlens.settings import Buckets, Detection, Slots

LOGGED = ["event_id", "t_us", "protocol", "source_id", "direction", "event", "bytes", "detail"]


def _of(capture: DataFrame, protocol: str, direction: str) -> DataFrame:
    return capture.filter((F.col("protocol") == protocol) & (F.col("direction") == direction))


def decided_packets(
    capture: DataFrame, settings: Detection = Detection(), *, by_connection: bool = False, buckets: Buckets = Buckets(), slots: Slots | None = None
) -> DataFrame:
    """Client packets with ``frames``, ``mid`` (CoAP) and their decision.

    ``capture``: ``event_id, t_us, protocol, endpoint, direction, payload``.  By default all MQTT packets but CONNECT are one source, so
    give ``slots`` for busy captures; ``by_connection`` names them after the last CONNECT of their endpoint.
    """
    mqtt = decode.mqtt_decode(decode.mqtt_frames(_of(capture, "mqtt", "incoming"))).drop("payload")
    coap = decode.coap_decode(_of(capture, "coap", "incoming")).drop("payload").withColumn("frames", F.lit(1))
    if by_connection:
        mqtt = decode.carry_client_id(mqtt)
    events = mqtt.unionByName(coap, allowMissingColumns=True)
    scored = detect.evaluate(vectors.behavioral_vector(events, detect.NEEDED_FEATURES, buckets=buckets, slots=slots), settings)
    return scored.select(*LOGGED, "mid", "frames", "anomaly_score", "allow", "action", "reason")


def responses(capture: DataFrame, decided: DataFrame) -> DataFrame:
    """CoAP responses with the allowed request they answer (``operators.correlate.route_responses``)."""
    columns = [*LOGGED, "mid"]
    asked = decided.filter(F.col("allow") & (F.col("protocol") == "coap")).select(columns)
    answers = decode.coap_decode(_of(capture, "coap", "outgoing")).select(columns)
    return correlate.route_responses(asked.unionByName(answers))


def log_rows(decided: DataFrame, broker: DataFrame, answered: DataFrame) -> DataFrame:
    """Log rows of decided client packets, packets of the broker and responses; a response has its client as source."""
    back = correlate.response_log(answered.withColumn("source_id", F.col("endpoint")), "source_id")
    return detect.route(decided).unionByName(broker.select(LOGGED)).unionByName(back)


def packet_log(capture: DataFrame, decided: DataFrame) -> DataFrame:
    """The whole log of a capture, ready for ``sources.logs.write_event_log``."""
    broker = decode.mqtt_decode(_of(capture, "mqtt", "outgoing"))
    return log_rows(decided, broker, responses(capture, decided))
