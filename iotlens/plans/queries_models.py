"""Queries: trained models (rows only) and stream runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from iotlens.functions.numeric import round6 as r6
from iotlens.operators import detect, evaluate, models, vectors
from iotlens.plans import oracle_base as B
from iotlens.plans.queries_packets import WITH_RESPONSES
from iotlens.plans.registry import register
from iotlens.schemas import FEATURES
from iotlens.session import shared_dir
from iotlens.sources.fixture import TRIGGER_BYTES, disorder_us, incoming, packet_event_stream, packet_events
from iotlens.streaming import flows
from iotlens.streaming import state_stream as SS

q6 = B.round6


def _rows(spark, sf):
    return vectors.legacy_vector(packet_events(spark, sf).drop("payload")).select(
        "event_id", "run_id", "protocol", "label", *FEATURES
    )


def _model_query(model: str):
    @register(f"model_{model}")
    def run(spark, sf):
        """Every row predicted once, by the model of the other four folds; whole runs are held out."""
        # Five fits and predictions read the vectors: they are written once.
        rows, folder = _rows(spark, sf), _folder(spark)
        rows.write.parquet(folder)
        rows = spark.read.schema(rows.schema).parquet(folder)
        out = models.experiment(rows, models=(model,), feature_sets=("full",), splits=("grouped_cv",))
        return out.select("event_id", "label", "fold", "predicted")

    return run


for _name in models.BUILDERS:
    _model_query(_name)


@register("model_decisions")
def model_decisions(spark, sf):
    """Score ``1 - P(benign)`` of a fitted model as the anomaly score of the detector."""
    rows = _rows(spark, sf)
    scored = models.score(models.fit(rows, "logreg"), rows)
    return detect.evaluate(scored, model_score="model_score").select("event_id", "anomaly_score", "action", "reason")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def _whole(spark, stream, rows, keys, trigger_bytes):
    """All rows of a stream over a stored table: rows wait as long as the order of its files asks for."""
    flows.use_rocksdb(spark)
    delay = disorder_us(rows, keys, trigger_bytes)
    on_time, late = flows.run_to_end(lambda ends: stream(delay, ends), rows.select(*keys), _folder(spark))
    if n := late.count():
        raise RuntimeError(f"{n} rows came behind a delay of {delay} us")
    return on_time


@register("stream_behavioral_vector", B.WITH_BEHAVIORAL + "SELECT event_id, " + ", ".join(f"{q6(f)} AS {f}" for f in FEATURES) + " FROM bv")
def stream_behavioral_vector(spark, sf, trigger_bytes=TRIGGER_BYTES):
    events = incoming(packet_event_stream(spark, sf, trigger_bytes))
    picked = ["event_id", *[r6(f).alias(f) for f in FEATURES], "late"]
    return _whole(
        spark, lambda delay, ends: SS.features_and_late(events, delay, ends).select(*picked),
        incoming(packet_events(spark, sf)), ["protocol", "source_id"], trigger_bytes)


@register(
    "stream_request_response",
    WITH_RESPONSES + " SELECT event_id, mid, routed, CASE WHEN routed THEN prev_source END AS endpoint, "
    "CASE WHEN routed THEN prev_id END AS request_id, CASE WHEN routed THEN t_us - prev_us END AS latency_us FROM resp",
)
def stream_request_response(spark, sf, trigger_bytes=TRIGGER_BYTES):
    coap = F.col("protocol") == "coap"
    events = packet_event_stream(spark, sf, trigger_bytes).filter(coap)
    picked = ["event_id", "mid", "routed", "endpoint", "request_id", "latency_us", "late"]
    return _whole(
        spark, lambda delay, ends: flows.response_stream(events, delay_us=delay, closing=ends).select(*picked),
        packet_events(spark, sf).filter(coap), ["mid"], trigger_bytes)
