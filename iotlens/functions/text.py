"""Text helpers: tags, depth, classes, badges, stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from iotlens.functions.numeric import _c, clamp01, norm
from iotlens.settings import DEPTH_CAP


def contains(text, needle: str) -> Column:
    return _c(text).contains(needle)


def tag_value(detail, key: str) -> Column:
    """Text after the first ``key`` up to the next ``|``; empty when the key is absent."""
    d = F.coalesce(_c(detail), F.lit(""))
    at = F.locate(key, d)
    rest = F.substr(d, at + len(key))
    return F.when(at > 0, F.substring_index(rest, "|", 1)).otherwise(F.lit(""))


def resource_depth(resource) -> Column:
    r = _c(resource)
    slashes = F.length(r) - F.length(F.replace(r, F.lit("/"), F.lit("")))
    return F.when(F.length(r) == 0, F.lit(0.0)).otherwise(norm(slashes + 1, DEPTH_CAP))


def normalise(text) -> Column:
    return F.lower(F.trim(F.coalesce(_c(text), F.lit(""))))


def wildcard_ratio(detail) -> Column:
    d = _c(detail)
    marks = F.length(d) - F.length(F.translate(d, "#+", ""))
    return clamp01(marks / 4.0)


def attack_class(label) -> Column:
    """Protocol-neutral class of a label."""
    lab = F.lower(F.trim(_c(label)))
    return (
        F.when(lab == "benign", "benign")
        .when(lab.contains("flood"), "flood")
        .when(lab.contains("protocol_abuse"), "protocol_abuse")
        .when(lab.contains("wildcard"), "wildcard")
        .otherwise("other")
    )


def badge(kind, level) -> Column:
    """Feed badge from an event's type, or its level when the type is absent."""
    t = F.lower(F.coalesce(_c(kind), _c(level), F.lit("")))
    hit = t.contains("detect") | t.contains("attack") | t.contains("anomal")
    return F.when(hit, "Detection").when(t.contains("warn"), "Warning").otherwise("Info")


def feed_time(ts, timestamp) -> Column:
    return F.coalesce(_c(ts), _c(timestamp), F.lit(""))


def feed_message(msg, message, whole_json) -> Column:
    """First of the two message fields, else the start of the event's JSON text (a display rule)."""
    return F.coalesce(_c(msg), _c(message), F.substring(_c(whole_json), 1, 120))


def utc_stamp(t_us) -> Column:
    """``2024-01-01T00:00:00Z`` from UTC micros (session zone must be UTC)."""
    return F.date_format(F.timestamp_micros(_c(t_us)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_stamp_micros(t_us) -> Column:
    return F.concat(F.date_format(F.timestamp_micros(_c(t_us)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def stamp_micros(stamp) -> Column:
    """UTC micros from a stamp text."""
    return F.unix_micros(F.try_to_timestamp(_c(stamp)))
