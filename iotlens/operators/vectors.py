"""Feature vectors: raw, stateless, dataset and behavioral."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotlens.functions import detail as D
from iotlens.functions import entropy as E
from iotlens.functions import text as X
from iotlens.functions.numeric import _c, clamp01, log_size, norm, pop_std, size_per_resource, to_float
from iotlens.operators import state
from iotlens.schemas import COAP_AUX, FEATURE_GROUPS, FEATURES, MQTT_AUX, PROTOCOL_ID, SHARED
from iotlens.settings import (
    BREADTH_CAP,
    GAP_CAP_MS,
    KEEPALIVE_CAP,
    OPTION_CAP,
    RATE_CAP,
    RECONNECT_CAP,
    RESOURCE_CAP,
    SESSION_CAP_S,
    SIZE_STD_CAP,
    Buckets,
    Slots,
)


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def _choose(mqtt, coap) -> Column:
    def as_double(v):
        return v.cast("double") if isinstance(v, Column) else F.lit(float(v))

    return F.when(F.col("protocol") == "mqtt", as_double(mqtt)).otherwise(as_double(coap))


def raw_features(events: DataFrame) -> DataFrame:
    """Bytes, source id length and payload entropy next to the event's columns."""
    return events.select(
        "*",
        F.col("bytes").cast("double").alias("raw_bytes"),
        F.octet_length("source_id").cast("double").alias("raw_source_len"),
        E.byte_entropy("payload").alias("raw_entropy"),
    )


def protocol_one_hot(protocol) -> tuple[Column, Column]:
    """(1, 0) for mqtt, (0, 1) for coap; any other protocol stops the query."""
    p = _c(protocol)
    bad = F.raise_error(F.concat(F.lit("unsupported protocol: "), F.coalesce(p, F.lit("null")))).cast("double")
    first = F.when(p == "mqtt", 1.0).when(p == "coap", 0.0).otherwise(bad)
    return first, F.lit(1.0) - first


def pad_vector(shared: Column, protocol, aux: Column) -> Column:
    """15 shared values + one-hot + 8 auxiliary values of the protocol, zero-padded to 33."""
    mqtt, coap = protocol_one_hot(protocol)
    zeros = F.array_repeat(F.lit(0.0), 8)
    tail = F.when(_c(protocol) == "mqtt", F.concat(aux, zeros)).otherwise(F.concat(zeros, aux))
    sized = F.when((F.size(shared) == 15) & (F.size(aux) == 8), F.concat(shared, F.array(mqtt, coap), tail))
    return F.coalesce(
        sized, F.raise_error(F.lit("need 15 shared and 8 auxiliary values")).cast(T.ArrayType(T.DoubleType()))
    )


def legacy_columns(detail="detail", direction="direction", event="event", size="bytes") -> dict[str, Column]:
    """Stateless vector from one event; one projection, no shuffle."""
    d, ev, b = _c(detail), _c(event), _c(size)
    opened = ev == "connection_open"
    abused = D.any_of(d, "error", "abuse")
    wild = d.contains("wildcard")
    shared = [
        F.when(ev == "traffic", 1.0).otherwise(0.2),
        F.lit(0.5),
        log_size(b),
        F.when(b > 0, 0.5).otherwise(0.0),
        _choose(0.25, 0.3),
        _choose(0.45, 0.5),
        _choose(0.5, _flag(d.contains("con"))),
        _choose(0.5, 0.3),
        _choose(0.2, 0.25),
        F.when(abused, 0.6).otherwise(0.05),
        _choose(F.when(opened, 0.6).otherwise(0.2), F.when(_c(direction) == "outgoing", 0.6).otherwise(0.2)),
        _choose(F.when(wild, 0.7).otherwise(0.15), 0.4),
        _choose(F.when(opened, 0.8).otherwise(0.2), 0.3),
        _choose(norm(b / 20.0, 50.0), norm(b / 16.0, 64.0)),
        F.when(d.contains("malform"), 0.3).otherwise(0.95),
    ]
    ids = [_choose(1.0, 0.0), _choose(0.0, 1.0)]
    aux = [
        F.lit(0.0), _choose(_flag(wild), 0.0), _choose(F.when(opened, 1.0).otherwise(0.2), 0.0), _choose(0.6, 0.0),
        F.lit(0.0), _choose(0.2, 0.0), _choose(0.5, 0.0), _choose(norm(b, 2048.0), 0.0),
    ]
    return dict(zip(FEATURES, [*shared, *ids, *aux, *[F.lit(0.0)] * 8], strict=True))


def legacy_vector(events: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    cols = legacy_columns()
    return events.select("*", *[cols[f].alias(f) for f in features])


def dataset_vector(events: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Stateless vector on trimmed, lower-cased text and a forgiving size."""
    cols = legacy_columns(
        detail=X.normalise("detail"),
        direction=X.normalise("direction"),
        event=X.normalise("event"),
        size=to_float("bytes"),
    )
    return events.select("*", *[cols[f].alias(f) for f in features])


def dataset_rows(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Labeled dataset rows: mqtt/coap events, run columns and the 33 features.

    ``runs`` is the manifest (run_id, scenario, label, rep); without it the columns must
    already be on the events.  The join is left to the planner, which broadcasts a
    manifest under its size limit and shuffles a larger one.
    """
    rows = events.withColumn("protocol", X.normalise("protocol")).filter(F.col("protocol").isin("mqtt", "coap"))
    if runs is not None:
        rows = rows.join(runs.select("run_id", "scenario", "label", "rep"), "run_id")
    rows = dataset_vector(rows)
    stamp = F.col("ts") if "ts" in events.columns else X.utc_stamp("t_us")
    return rows.select(
        "run_id", "scenario", "label", F.col("rep").cast("int").alias("rep"), stamp.alias("timestamp"),
        "protocol", "direction", "event", to_float("bytes").cast("long").alias("bytes"), "detail", *FEATURES,
    )


# State columns that each behavioral feature reads.
NEEDS = {
    "f00": ["n1"], "f01": ["gap_ms"], "f07": ["start_us"], "f08": ["resources10"],
    "f09": ["err10", "n10"], "f10": ["hs10", "n10"], "f11": ["breadth30"], "f12": ["open30"],
    "f14": ["err10", "n10"], "f24": ["n30", "b30", "bb30"], "f32": ["opt10", "n10"],
    **{f: ["con10", "non10", "ack10", "rst10"] for f in ("f25", "f26", "f27", "f28")},
}


def _share(name: str) -> Column:
    total = F.col("con10") + F.col("non10") + F.col("ack10") + F.col("rst10")
    return _choose(0.0, F.when(total > 0, F.col(name).cast("double") / total).otherwise(0.0))


def behavioral_columns(resource: Column | None = None) -> dict[str, Column]:
    """The 33 features from an event's own columns plus the per-source state."""
    d = F.col("detail")
    res = D.resource(d) if resource is None else resource
    opened = D.is_open("event")
    # A window always holds its own row; the guard only matters where a filter is evaluated early.
    rows10 = F.nullif(F.col("n10"), F.lit(0))
    errors = F.col("err10").cast("double") / rows10
    shared = [
        norm(F.col("n1"), RATE_CAP),
        F.lit(1.0) - clamp01(F.col("gap_ms") / float(GAP_CAP_MS)),
        log_size("bytes"),
        clamp01(F.col("payload_entropy") / 8.0),
        X.resource_depth(res),
        E.text_entropy_unit(res),
        D.qos_level("protocol", d),
        norm((F.col("t_us") - F.col("start_us")) / 1e6, SESSION_CAP_S),
        norm(F.col("resources10"), RESOURCE_CAP),
        errors,
        F.col("hs10").cast("double") / rows10,
        norm(F.col("breadth30"), BREADTH_CAP),
        norm(F.col("open30"), RECONNECT_CAP),
        size_per_resource("bytes", F.octet_length(res)),
        F.lit(1.0) - errors,
    ]
    ids = [_choose(1.0, 0.0), _choose(0.0, 1.0)]
    mqtt = [
        _flag(d.contains("retain")),
        X.wildcard_ratio(d),
        F.when(opened, 1.0).otherwise(0.2),
        norm(D.keepalive(d), KEEPALIVE_CAP),
        _flag(d.contains("will")),
        _flag(D.is_qos2_flow(d)),
        E.text_entropy_unit("source_id"),
        norm(pop_std("n30", "b30", "bb30"), SIZE_STD_CAP),
    ]
    options = F.col("opt10") / float(state.OPTION_SCALE) / rows10
    coap = [
        _share("con10"), _share("non10"), _share("ack10"), _share("rst10"),
        _choose(0.0, _flag(d.contains("observe"))),
        _choose(0.0, _flag(d.contains("blockwise"))),
        _choose(0.0, F.when(d.contains("token:"), 0.5).otherwise(0.0)),
        _choose(0.0, norm(options, OPTION_CAP)),
    ]
    return dict(zip(FEATURES, [*shared, *ids, *[_choose(c, 0.0) for c in mqtt], *coap], strict=True))


def behavioral_vector(
    events: DataFrame, features: Sequence[str] = FEATURES, *, buckets: Buckets = Buckets(), slots: Slots | None = None
) -> DataFrame:
    """Client packets with the asked-for behavioral features.

    The payload is reduced to its entropy before the exchange, and only state that the
    asked-for features read is computed.
    """
    rows = events
    if "payload" in events.columns:
        if "f03" in features:
            rows = rows.withColumn("payload_entropy", E.byte_entropy("payload"))
        rows = rows.drop("payload")
    elif "f03" in features and "payload_entropy" not in events.columns:
        rows = rows.withColumn("payload_entropy", F.lit(0.0))
    needed = [n for f in features for n in NEEDS.get(f, [])]
    rows = state.source_state(rows, needed, buckets=buckets, slots=slots) if needed else rows
    # Read from the text once; four features use it.
    rows = rows.withColumn("_resource", D.resource("detail"))
    cols = behavioral_columns(F.col("_resource"))
    kept = [c for c in events.columns if c != "payload"]
    return rows.select(*kept, *[cols[f].alias(f) for f in features])


def both_vectors(events: DataFrame, *, behavioral_enabled: bool = True, buckets: Buckets = Buckets()) -> DataFrame:
    """Feature-log form: ``legacy``, ``behavioral`` and ``active`` arrays of 33."""
    rows = behavioral_vector(events, buckets=buckets)
    legacy = legacy_columns()
    pair = rows.select(
        *[c for c in rows.columns if c not in FEATURES],
        F.array(*[legacy[f] for f in FEATURES]).alias("legacy"),
        F.array(*[F.col(f) for f in FEATURES]).alias("behavioral"),
    )
    active = "behavioral" if behavioral_enabled else "legacy"
    return pair.select("*", F.lit(behavioral_enabled).alias("behavioral_enabled"), F.col(active).alias("active"))


def active_vector(events: DataFrame, *, behavioral_enabled: bool, features: Sequence[str] = FEATURES) -> DataFrame:
    """The vector the detector reads; only the chosen one is computed."""
    if behavioral_enabled:
        return behavioral_vector(events, features)
    return legacy_vector(events.drop("payload"), features)


def to_array(df: DataFrame, name: str = "features", features: Sequence[str] = FEATURES) -> DataFrame:
    kept = [c for c in df.columns if c not in FEATURES]
    return df.select(*kept, F.array(*[F.col(f) for f in features]).alias(name))


def to_wide(df: DataFrame, name: str = "features", features: Sequence[str] = FEATURES) -> DataFrame:
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, *[F.col(name)[i].alias(f) for i, f in enumerate(features)])


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per event and feature (map-side expansion, no shuffle)."""
    return df.unpivot(list(ids), list(features), "feature", "value")


def feature_spec(spark) -> DataFrame:
    """Feature position, name and group."""
    rows = [
        (FEATURES.index(f), f, group) for group, members in FEATURE_GROUPS.items() for f in members
    ]
    return spark.createDataFrame(rows, "position int, feature string, feature_group string")


assert len(SHARED) + len(PROTOCOL_ID) + len(MQTT_AUX) + len(COAP_AUX) == len(FEATURES)
