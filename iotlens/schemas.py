"""Table schemas and the feature groups."""

from __future__ import annotations

from pyspark.sql import types as T

FEATURES = [f"f{i:02d}" for i in range(33)]
SHARED = FEATURES[:15]
PROTOCOL_ID = FEATURES[15:17]
MQTT_AUX = FEATURES[17:25]
COAP_AUX = FEATURES[25:33]

FEATURE_SETS = {
    "normalized": SHARED,
    "normalized_plus_pid": SHARED + PROTOCOL_ID,
    "full": FEATURES,
}

FEATURE_GROUPS = {
    "normalized": SHARED,
    "protocol_identifier": PROTOCOL_ID,
    "mqtt_auxiliary": MQTT_AUX,
    "coap_auxiliary": COAP_AUX,
}

# Label names in the order of the champion table.
LABELS = [
    "benign",
    "mqtt_protocol_abuse",
    "mqtt_wildcard_abuse",
    "mqtt_publish_flood",
    "coap_request_flood",
    "coap_protocol_abuse",
]

PROTOCOLS = ["mqtt", "coap"]

EVENT_LOG = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("bytes", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)

DECISION = T.StructType(
    [
        T.StructField("allow", T.BooleanType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
    ]
)

FEATURE_LOG = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("raw_bytes", T.DoubleType()),
        T.StructField("behavioral_enabled", T.BooleanType()),
        T.StructField("legacy", T.ArrayType(T.DoubleType())),
        T.StructField("behavioral", T.ArrayType(T.DoubleType())),
        T.StructField("active", T.ArrayType(T.DoubleType())),
        T.StructField("decision", DECISION),
    ]
)

DATASET_META = [
    T.StructField("run_id", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("rep", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("detail", T.StringType()),
]
DATASET = T.StructType(DATASET_META + [T.StructField(f, T.DoubleType()) for f in FEATURES])

FEATURE_RECORD = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("timestamp", "protocol", "source_id", "attack_label", "attack_family")
    ]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)

SNAPSHOT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("mqtt_msgs", "coap_msgs", "detections", "latency_ms_p95")]
)

CAPTURE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
