"""Packet decode: binary capture rows to packet events.

Fixed-offset fields are column expressions over single bytes of the payload; only walks
of unknown length (see ``walks``) run in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.functions.numeric import _c, settled
from iotlens.operators import walks
from iotlens.operators.correlate import last_known

# Names of MQTT packet types 1 to 14.
MQTT_NAMES = [
    "connect", "connack", "publish", "puback", "pubrec", "pubrel", "pubcomp",
    "subscribe", "suback", "unsubscribe", "unsuback", "pingreq", "pingresp", "disconnect",
]
# Names of CoAP message types 0 to 3 and of method codes 1 to 4.
COAP_TYPES = ["con", "non", "ack", "rst"]
COAP_METHODS = ["get", "post", "put", "delete"]

MQTT_DEFAULT_SOURCE = "mqtt-client"


def byte_at(payload, offset) -> Column:
    """Byte value at a 0-based offset (0 past the end)."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.ascii(F.decode(F.substr(_c(payload), at + 1, F.lit(1)), "ISO-8859-1"))


def u16_at(payload, offset) -> Column:
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return byte_at(payload, at) * 256 + byte_at(payload, at + 1)


def mqtt_name(packet_type: Column) -> Column:
    names = F.array(*[F.lit(n) for n in MQTT_NAMES])
    return F.when(packet_type.between(1, 14), F.get(names, packet_type - 1)).otherwise("unknown")


def _length_field() -> tuple[Column, Column]:
    """(remaining length, bytes used) from the columns ``_e1``..``_e4``; null when invalid."""
    more, used, total = F.lit(True), [], F.lit(0)
    for i in (1, 2, 3, 4):
        byte = F.col(f"_e{i}")
        used.append(F.when((F.col("size") > i) & more & (byte < 128), i))
        more = more & (byte >= 128)
    n = F.coalesce(*used)
    for i in (1, 2, 3, 4):
        total = total + F.when(F.col("_used") >= i, (F.col(f"_e{i}") % 128) * (128 ** (i - 1))).otherwise(0)
    return total, n


def _with_span(df: DataFrame, name: str, offset: str) -> DataFrame:
    """Adds ``<name>_at`` and ``<name>_len`` of a length-prefixed string; null when it does not fit."""
    off = F.col(offset)
    df = settled(df, {f"{name}_len": F.when(off + 2 <= F.col("size"), u16_at("payload", off))})
    fits = off + 2 + F.col(f"{name}_len") <= F.col("size")
    return df.withColumn(f"{name}_at", F.when(fits, off + 2))


def _text_of(name: str) -> Column:
    """Bytes of a span as text, unchanged; empty when the span is missing."""
    return F.coalesce(F.substr(F.col("payload"), F.col(f"{name}_at") + 1, F.col(f"{name}_len")).cast("string"), F.lit(""))


def mqtt_fields(capture: DataFrame) -> DataFrame:
    """Header, CONNECT, PUBLISH and SUBSCRIBE fields of the first frame of each payload."""
    size = F.octet_length("payload")
    head = settled(
        capture,
        {"size": size, "_b0": byte_at("payload", 0), **{f"_e{i}": byte_at("payload", i) for i in (1, 2, 3, 4)}},
    )
    total, used = _length_field()
    head = settled(head.withColumn("_used", used), {"remaining_length": F.when(F.col("_used").isNotNull(), total)})
    head = head.withColumns({"packet_type": F.shiftright("_b0", 4), "_body": 1 + F.col("_used")})
    head = head.withColumn(
        "malformed", F.col("_used").isNull() | (F.col("_body") + F.col("remaining_length") > F.col("size"))
    )
    # The first string is the protocol name of a CONNECT or the topic of a PUBLISH.
    head = _with_span(head, "_first", "_body")
    after = F.col("_first_at") + F.col("_first_len")
    head = settled(head, {"_flags_at": F.when(after + 4 <= F.col("size"), after)}).withColumn(
        "_id_prefix", F.col("_flags_at") + 4
    )
    head = _with_span(head, "_id", "_id_prefix")
    client_id, topic = _text_of("_id"), _text_of("_first")
    filters = F.substr(F.col("payload"), F.col("_body") + 3, F.col("size"))
    connect, publish, subscribe = (F.col("packet_type") == i for i in (1, 3, 8))
    return head.select(
        *capture.columns,
        "size",
        "packet_type",
        mqtt_name(F.col("packet_type")).alias("packet"),
        "remaining_length",
        "malformed",
        F.when(connect, client_id).alias("client_id"),
        F.when(
            connect, F.coalesce(F.shiftright(byte_at("payload", F.col("_flags_at") + 1), 2) % 2 == 1, F.lit(False))
        ).alias("will"),
        F.when(connect, F.coalesce(u16_at("payload", F.col("_flags_at") + 2), F.lit(0))).alias("keepalive"),
        F.when(publish, F.shiftright("_b0", 1) % 4).alias("qos"),
        F.when(publish, F.col("_b0") % 2 == 1).alias("retain"),
        F.when(publish, topic).alias("topic"),
        F.when(
            subscribe & (F.col("_body") + 2 <= F.col("size")),
            walks.mqtt_filters_wild(F.when(subscribe, filters)),
        ).alias("wildcard"),
    )


def _route(direction, client: str, server: str) -> Column:
    """Route prefix of the detail text by direction."""
    return F.when(_c(direction) == "outgoing", f"{server}_to_client").otherwise(f"client_to_{server}")


def reroute(detail, server: str) -> Column:
    """Detail of a server reply: the client prefix is replaced, or a reply prefix is added."""
    d, mine = _c(detail), f"client_to_{server}"
    rest = F.substr(d, F.lit(len(mine) + 1))
    return F.when(d.startswith(f"{mine}|"), F.concat(F.lit(f"{server}_to_client"), rest)).otherwise(
        F.concat(F.lit(f"{server}_to_client|"), d)
    )


def mqtt_decode(capture: DataFrame) -> DataFrame:
    """Capture rows of MQTT traffic to packet events."""
    f = mqtt_fields(capture)
    connect, publish = F.col("packet_type") == 1, F.col("packet_type") == 3
    tags = F.concat_ws(
        "|",
        _route("direction", "client", "broker"),
        "packet",
        F.when(F.col("malformed"), "malform"),
        F.when(connect & (F.col("client_id") != ""), F.concat(F.lit("client_id:"), "client_id")),
        F.when(F.col("will"), "will"),
        F.when(connect, F.concat(F.lit("keepalive:"), F.col("keepalive").cast("string"))),
        F.when(publish, F.concat(F.lit("qos:"), F.col("qos").cast("string"))),
        F.when(F.col("retain"), "retain"),
        F.when(publish & (F.col("topic") != ""), F.concat(F.lit("topic:"), "topic")),
        F.when(F.col("wildcard"), "wildcard"),
    )
    empty = F.concat(_route("direction", "client", "broker"), F.lit("|malform|empty"))
    nothing = F.col("size") == 0
    return f.select(
        *[c for c in capture.columns if c not in ("source_id", "event", "detail", "bytes")],
        F.when(~nothing & (F.col("client_id") != ""), F.col("client_id")).otherwise(MQTT_DEFAULT_SOURCE).alias("source_id"),
        F.when(~nothing & connect, "connection_open").otherwise("traffic").alias("event"),
        F.col("size").cast("long").alias("bytes"),
        F.when(nothing, empty).otherwise(tags).alias("detail"),
    )


def carry_client_id(events: DataFrame) -> DataFrame:
    """Names every packet after the last CONNECT of its connection (``endpoint``).

    Without it all packets but CONNECT share one source, as in the default rules.
    """
    named = F.when(F.col("event") == "connection_open", F.col("source_id"))
    known = last_known(events.withColumn("_named", named), ["endpoint"], "t_us", ["event_id"], "_named")
    return known.withColumn("source_id", F.coalesce("_named", "source_id")).select(*events.columns)


def mqtt_frames(capture: DataFrame) -> DataFrame:
    """Adds ``frames``: number of complete frames in each payload."""
    return capture.withColumn("frames", F.size(walks.mqtt_frame_ends("payload")))


def split_frames(capture: DataFrame) -> DataFrame:
    """One row per complete frame, with its position and bytes."""
    ends = capture.withColumn("_ends", walks.mqtt_frame_ends("payload"))
    each = ends.select("*", F.posexplode("_ends").alias("frame_no", "_end"))
    start = F.when(F.col("frame_no") > 0, F.get("_ends", F.col("frame_no") - 1)).otherwise(0)
    frame = F.substr(F.col("payload"), start + 1, F.col("_end") - start)
    return each.withColumn("frame", frame).drop("_ends", "_end", "payload")


def message_id(payload) -> Column:
    """CoAP message id; null below 4 bytes."""
    return F.when(F.octet_length(_c(payload)) >= 4, u16_at(payload, 2))


def coap_header(capture: DataFrame) -> DataFrame:
    head = capture.select(
        "*",
        F.octet_length("payload").alias("size"),
        byte_at("payload", 0).alias("_b0"),
        byte_at("payload", 1).alias("_code"),
    ).withColumn("token_length", F.col("_b0") % 16)
    code, token_len, short = F.col("_code"), F.col("token_length"), F.col("size") < 4
    name = F.get(F.array(*[F.lit(m) for m in COAP_METHODS]), code - 1)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(token_len, F.lit(1))), lambda i: F.lower(F.hex(byte_at("payload", i + 3).cast("long")))
    )
    return head.select(
        *capture.columns,
        "size",
        short.alias("short_header"),
        F.shiftright("_b0", 6).alias("version"),
        F.get(F.array(*[F.lit(x) for x in COAP_TYPES]), F.shiftright("_b0", 4) % 4).alias("type"),
        "token_length",
        F.when(code.between(1, 4), name).otherwise(F.concat(F.lit("code:"), code.cast("string"))).alias("code"),
        F.when(~short, u16_at("payload", 2)).alias("mid"),
        ((F.shiftright("_b0", 6) != 1) | (token_len > 8) | (F.col("size") < 4 + token_len)).alias("bad_header"),
        F.when(token_len > 0, F.array_join(each, "")).alias("token"),
    )


def coap_fields(capture: DataFrame) -> DataFrame:
    """Header fields plus the option walk (null where the header is already faulty)."""
    h = coap_header(capture)
    options = F.when(
        ~F.col("short_header") & ~F.col("bad_header"),
        F.substr(F.col("payload"), F.col("token_length") + 5, F.col("size")),
    )
    walked = h.withColumn("_w", walks.coap_options(options))
    return walked.select(*h.columns, *[F.col(f"_w.{f.name}").alias(f.name) for f in walks.WALK])


def coap_decode(capture: DataFrame) -> DataFrame:
    """Capture rows of CoAP traffic to packet events; a faulty packet keeps its detail up to the fault."""
    f = coap_fields(capture)
    whole = ~F.col("bad_header")
    fine = whole & ~F.col("malformed")
    path = F.when(fine & (F.col("path") != ""), F.concat(F.lit("path:/"), "path"))
    tags = F.concat_ws(
        "|",
        _route("direction", "client", "backend"),
        "type",
        "code",
        F.when(~whole, "malform"),
        F.when(whole, F.concat(F.lit("token:"), "token")),
        F.when(whole & F.col("malformed"), "malform"),
        path,
        F.when(fine & (F.col("path") == ".well-known/core"), "discovery"),
        F.when(fine & F.col("observe"), "observe"),
        F.when(fine & F.col("blockwise"), "blockwise"),
        F.when(fine, F.concat(F.lit("optcount:"), F.col("options").cast("string"))),
    )
    short = F.concat(_route("direction", "client", "backend"), F.lit("|malform|short_header"))
    return f.select(
        *[c for c in capture.columns if c not in ("source_id", "event", "detail", "bytes", "mid")],
        F.col("endpoint").alias("source_id"),
        F.lit("traffic").alias("event"),
        F.col("size").cast("long").alias("bytes"),
        F.when(F.col("short_header"), short).otherwise(tags).alias("detail"),
        "mid",
    )
