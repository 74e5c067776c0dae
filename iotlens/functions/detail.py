"""Flags and tags read from an event's ``detail`` text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from iotlens.functions.numeric import _c, prefix_float
from iotlens.functions.text import tag_value
from iotlens.settings import KEEPALIVE_DEFAULT


def resource(detail) -> Column:
    """Topic if present, else path."""
    topic = tag_value(detail, "topic:")
    return F.when(topic != "", topic).otherwise(tag_value(detail, "path:"))


def any_of(detail, *needles: str) -> Column:
    d = _c(detail)
    out = d.contains(needles[0])
    for n in needles[1:]:
        out = out | d.contains(n)
    return out


def has_error(detail) -> Column:
    return any_of(detail, "error", "abuse", "malform")


def is_breadth(detail) -> Column:
    return any_of(detail, "wildcard", "observe")


def type_mark(detail, name: str) -> Column:
    """A message type next to a bar on either side; ``|con`` therefore also matches ``|connect``."""
    return any_of(detail, f"|{name}", f"{name}|")


def is_qos2_flow(detail) -> Column:
    return any_of(detail, "pubrec", "pubrel", "pubcomp")


def is_open(event) -> Column:
    return _c(event) == "connection_open"


def is_handshake(event, detail) -> Column:
    return is_open(event) | is_qos2_flow(detail) | type_mark(detail, "ack") | type_mark(detail, "con")


def coap_type(detail) -> Column:
    """First matching type in the order con, non, ack, rst; null when there is none."""
    return (
        F.when(type_mark(detail, "con"), "con")
        .when(type_mark(detail, "non"), "non")
        .when(type_mark(detail, "ack"), "ack")
        .when(type_mark(detail, "rst"), "rst")
    )


def option_count(detail) -> Column:
    return prefix_float(tag_value(detail, "optcount:"), 0.0)


def keepalive(detail) -> Column:
    return prefix_float(tag_value(detail, "keepalive:"), KEEPALIVE_DEFAULT)


def qos_level(protocol, detail) -> Column:
    d = _c(detail)
    mqtt = F.when(d.contains("qos:2"), 1.0).when(d.contains("qos:1"), 0.5).otherwise(0.0)
    return F.when(_c(protocol) == "mqtt", mqtt).otherwise(F.when(type_mark(detail, "con"), 1.0).otherwise(0.0))


def parsed_columns(detail="detail", event="event") -> dict[str, Column]:
    """All tags and flags of the detail text as typed columns."""
    d = _c(detail)
    return {
        "route": F.substring_index(d, "|", 1),
        "resource": resource(d),
        "qos": F.nullif(tag_value(d, "qos:"), F.lit("")).try_cast("int"),
        "client_id": tag_value(d, "client_id:"),
        "keepalive_s": keepalive(d),
        "token": tag_value(d, "token:"),
        "opt_count": option_count(d),
        "coap_type": coap_type(d),
        "is_error": has_error(d),
        "is_handshake": is_handshake(event, d),
        "is_breadth": is_breadth(d),
        "is_reconnect": is_open(event),
        "retain": d.contains("retain"),
        "wildcard": d.contains("wildcard"),
        "will": d.contains("will"),
        "malform": d.contains("malform"),
        "qos2_flow": is_qos2_flow(d),
        "observe": d.contains("observe"),
        "blockwise": d.contains("blockwise"),
        "discovery": d.contains("discovery"),
    }
