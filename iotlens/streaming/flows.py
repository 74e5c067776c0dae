"""Stream sources, routing sinks, counters and request/response state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from iotlens.operators import counters, decode, detect
from iotlens.settings import Detection
from iotlens.sources import logs
from iotlens.streaming.state_stream import behind, features_and_late, release

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(df: DataFrame, folder: str, output_mode: str = "append") -> DataFrame:
    """Runs a stream over everything available into a parquet table and reads it back."""
    writer = df.writeStream.format("parquet").outputMode(output_mode)
    query = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def run_to_end(stream: Callable[[DataFrame], DataFrame], keys: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream that holds rows back over everything available and then to its end; gives on-time and late rows.

    ``stream`` makes it from a stream of closing rows, which has one row per key (``keys``) once all else has been read.
    """
    spark, ends = keys.sparkSession, f"{folder}/ends"
    keys.limit(0).write.parquet(ends)
    df = stream(spark.readStream.schema(keys.schema).parquet(ends))
    run_to_table(df, folder)
    keys.distinct().write.mode("append").parquet(ends)
    rows = run_to_table(df, folder)
    return rows.filter(~F.col("late")).drop("late"), rows.filter("late")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state that can outgrow memory needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def read_table_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet", files_per_trigger: int = 100, pattern: str = ""
) -> DataFrame:
    """File-backed stream of packets or events; the trigger limit bounds the rows of a batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, *, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """Topic-backed stream (needs the Kafka connector on the class path)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )


def route_stream(
    features: DataFrame, event_path: str, mitigation_path: str, checkpoint: str, settings: Detection = Detection(), **trigger
) -> StreamingQuery:
    """Scores a feature stream and writes allowed and denied rows to two places.

    Each batch writes to its own ``batch=<id>`` folder in overwrite mode, so a repeated batch
    replaces its rows instead of adding them twice.
    """
    routed = detect.route(detect.evaluate(features, settings))

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            denied = F.col("direction") == "mitigation"
            kept.filter(~denied).write.mode("overwrite").parquet(f"{event_path}/batch={batch_id}")
            kept.filter(denied).write.mode("overwrite").parquet(f"{mitigation_path}/batch={batch_id}")
        finally:
            kept.unpersist()

    writer = routed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


P95_ACCURACY = 10_000


def counter_stream(decided: DataFrame, snapshot_path: str, checkpoint: str, latency: str = "latency_us", **trigger) -> StreamingQuery:
    """Running counters and latency; the one-row snapshot gets a new version on every trigger (1 s by default).

    With a column ``latency`` (micros, null where unknown) its 95th percentile in whole milliseconds is kept by a mergeable
    quantile sketch in the state, within 1/``P95_ACCURACY`` of the rank; otherwise it is 0.  A version is written whole before
    older ones go, so a reader (``sources.logs.read_snapshot``) always finds one.
    """
    columns = dict(counters.counter_columns())
    if latency in decided.columns:
        p95 = F.percentile_approx(F.col(latency), 0.95, P95_ACCURACY)
        columns["latency_ms_p95"] = F.coalesce(F.floor(p95 / 1000), F.lit(0)).cast("long")
    else:
        columns["latency_ms_p95"] = F.lit(0).cast("long")
    totals = decided.agg(*[c.alias(n) for n, c in columns.items()])

    def flush(batch: DataFrame, batch_id: int) -> None:
        logs.write_version(batch, snapshot_path, batch_id)

    writer = totals.writeStream.outputMode("complete").foreachBatch(flush).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def split_late(events: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Watermark for time-windowed aggregates; event time from ``t_us``."""
    return events.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", delay)


def windowed_counts(events: DataFrame, delay: str = "30 seconds", width: str = "1 second") -> DataFrame:
    """Messages per protocol and window, closed after the delay."""
    return (
        split_late(events, delay)
        .groupBy("protocol", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes"))
        .select("protocol", F.unix_micros("w.start").alias("start_us"), "messages", "bytes")
    )


# ---- request/response ----------------------------------------------------------------------

ASKED = T.StructType(
    [T.StructField("endpoint", T.StringType()), T.StructField("asked_us", T.LongType()), T.StructField("request_id", T.LongType())]
)
ROUTED = T.StructType(
    [
        T.StructField("mid", T.IntegerType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("routed", T.BooleanType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("request_id", T.LongType()),
        T.StructField("latency_us", T.LongType()),
        T.StructField("late", T.BooleanType()),
    ]
)
HELD = T.StructType(
    [T.StructField(n, T.ArrayType(T.LongType())) for n in ("event_id", "t_us")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("direction", "source_id")]
)
LAST = T.StructType([T.StructField("t_us", T.LongType()), T.StructField("event_id", T.LongType())])


def match_in_order(rows: pd.DataFrame, pending: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    """Responses of one message id with their request; rows are in arrival order.

    ``pending`` is the unanswered request left by earlier rows, and the second result the
    one left by these.
    """
    asks = rows["direction"].eq("incoming").to_numpy()
    prior = pd.DataFrame(
        {
            "endpoint": rows["source_id"].where(asks).shift(1),
            "asked_us": rows["t_us"].where(asks).shift(1),
            "request_id": rows["event_id"].where(asks).shift(1),
        }
    ).astype({"endpoint": object, "asked_us": "Int64", "request_id": "Int64"})
    if pending is not None:
        prior.loc[prior.index[0]] = list(pending)
    out = pd.concat([rows[["mid", "event_id", "t_us"]], prior], axis=1)[~asks]
    out["routed"] = out["request_id"].notna()
    out["latency_us"] = out["t_us"].astype("Int64") - out["asked_us"]
    out["late"] = False
    last = rows.iloc[-1]
    left = (last["source_id"], int(last["t_us"]), int(last["event_id"])) if asks[-1] else None
    return out[[f.name for f in ROUTED.fields]], left


class PendingRequests(StatefulProcessor):
    """The unanswered request of one message id; an old one expires with the state's time to live.

    Rows wait ``delay_us`` of their id's event time for older ones.
    """

    def __init__(self, ttl_ms: int | None, delay_us: int = 0):
        self.ttl_ms, self.delay_us = ttl_ms, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.ttl_ms:
            self.asked = handle.getValueState("asked", ASKED, ttlDurationMs=self.ttl_ms)
        else:
            self.asked = handle.getValueState("asked", ASKED)
        self.held = handle.getValueState("held", HELD)
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        ends = rows["closing"].to_numpy(dtype=bool)
        ordered = rows.loc[~ends, HELD.fieldNames()].sort_values(["t_us", "event_id"], ignore_index=True)
        if self.last.exists():
            late = behind(ordered, tuple(self.last.get()), self.delay_us)
            if late.any():
                yield self._late(key, ordered[late])
            ordered = ordered[~late].reset_index(drop=True)
        if self.delay_us:
            ordered = release(self.held, HELD, ordered, self.delay_us, bool(ends.any()))
        if not len(ordered):
            return
        self.last.update((int(ordered["t_us"].iloc[-1]), int(ordered["event_id"].iloc[-1])))
        ordered = ordered.assign(mid=key[0])
        pending = tuple(self.asked.get()) if self.asked.exists() else None
        out, left = match_in_order(ordered, pending)
        if left is not None:
            self.asked.update(left)
        elif pending is not None:
            self.asked.clear()
        if len(out):
            yield out

    def _late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["event_id", "t_us"]].assign(mid=key[0], routed=False, endpoint=None, request_id=None, latency_us=None, late=True)
        return out.astype({"request_id": "Int64", "latency_us": "Int64"})[[f.name for f in ROUTED.fields]]

    def close(self) -> None:
        pass


def response_stream(
    messages: DataFrame, ttl_ms: int | None = None, delay_us: int = 0, closing: DataFrame | None = None
) -> DataFrame:
    """Stream form of ``operators.correlate.route_responses``; responses without an id are unrouted.

    Rows wait ``delay_us`` of their id's event time for older ones; a row of the stream ``closing`` (``mid``) releases what its
    id still holds.  Requests and responses behind what has been matched come out unrouted with ``late = true``.
    """
    columns = messages.select("mid", "event_id", "t_us", "direction", "source_id")
    mode = "processingTime" if ttl_ms else "none"
    rows = columns.filter(F.col("mid").isNotNull()).withColumn("closing", F.lit(False))
    if closing is not None:
        no = [F.lit(0).cast("long").alias(n) for n in ("event_id", "t_us")] + [F.lit("").alias(n) for n in ("direction", "source_id")]
        rows = rows.unionByName(closing.filter(F.col("mid").isNotNull()).select("mid", *no, F.lit(True).alias("closing")))
    matched = rows.groupBy("mid").transformWithStateInPandas(
        PendingRequests(ttl_ms, delay_us), ROUTED, outputMode="append", timeMode=mode
    )
    given = {"mid", "event_id", "t_us"}
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ROUTED.fields if f.name not in given | {"routed", "late"}]
    loose = columns.filter(F.col("mid").isNull() & (F.col("direction") != "incoming"))
    loose = loose.select("mid", "event_id", "t_us", F.lit(False).alias("routed"), *nothing, F.lit(False).alias("late"))
    return matched.unionByName(loose)


# ---- packets to log -------------------------------------------------------------------------

LOG = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)
# Rows without part in the matching are spread over so many keys.
SPREAD = 4096


class ResponseLog(StatefulProcessor):
    """Log rows of one message id: allowed requests as they are, responses as delivered or unrouted.

    The unanswered request is kept; an old one expires with the state's time to live.  Keys of a part above 0 only pass rows on.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.ttl_ms:
            self.asked = handle.getValueState("asked", ASKED, ttlDurationMs=self.ttl_ms)
            self.last = handle.getValueState("last", LAST, ttlDurationMs=self.ttl_ms)
        else:
            self.asked = handle.getValueState("asked", ASKED)
            self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = LOG.fieldNames()
        if key[1]:
            for batch in rows:
                yield batch[names]
            return
        rows = pd.concat(list(rows), ignore_index=True).sort_values(["t_us", "event_id"], ignore_index=True)
        if self.last.exists():
            late = behind(rows, tuple(self.last.get()), 0)
            if late.any():
                yield self._answers(rows[late], None)
            rows = rows[~late].reset_index(drop=True)
        if not len(rows):
            return
        self.last.update((int(rows["t_us"].iloc[-1]), int(rows["event_id"].iloc[-1])))
        pending = tuple(self.asked.get()) if self.asked.exists() else None
        out, left = match_in_order(rows.assign(mid=key[0]), pending)
        if left is not None:
            self.asked.update(left)
        elif pending is not None:
            self.asked.clear()
        yield self._answers(rows, out)

    def _answers(self, rows: pd.DataFrame, out: pd.DataFrame | None) -> pd.DataFrame:
        """Requests as they are; responses by what they were matched with (``out``, by row; none: not matched)."""
        log = rows[LOG.fieldNames()].copy()
        answers = log["direction"].ne("incoming")
        lost = answers if out is None else answers & ~out["routed"].reindex(log.index, fill_value=False)
        log.loc[answers, "source_id"] = None if out is None else out["endpoint"].reindex(log.index[answers])
        log.loc[lost, ["direction", "event", "detail"]] = ["internal", "unrouted_response", "missing message-id mapping"]
        log.loc[lost, "source_id"] = None
        return log

    def close(self) -> None:
        pass


def packet_log_stream(capture: DataFrame, settings: Detection = Detection(), ttl_ms: int | None = None) -> DataFrame:
    """Stream form of ``operators.gateway.packet_log``: windows per source, decision, matching per message id, chained in one query.

    Packets must come in time order per source and message id from trigger to trigger (inside a trigger any order will do).  A client
    packet behind its source has no windows and so no decision: it is logged as ``internal``, ``late_packet`` and goes no further.  A
    response behind its id is unrouted.
    """
    is_coap, client = F.col("protocol") == "coap", F.col("direction") == "incoming"
    coap = decode.coap_decode(capture.filter(is_coap))
    packets = decode.mqtt_decode(capture.filter(~is_coap)).unionByName(coap, allowMissingColumns=True).drop("payload")
    seen = detect.evaluate(features_and_late(packets.filter(client)), settings)
    late = F.col("late")
    for name, text in {"direction": "internal", "event": "late_packet", "detail": "behind newer packets of its source"}.items():
        seen = seen.withColumn(name, F.when(late, text).otherwise(F.col(name)))
    seen = seen.withColumns({"asks": ~late & F.col("allow") & is_coap, "allow": late | F.col("allow")})
    passed = ["mid", "asks"]
    decided = detect.route(seen, *passed)
    answers = packets.filter(~client).withColumn("asks", is_coap).select(*LOG.fieldNames(), F.col("mid").cast("long").alias("mid"), "asks")
    rows = decided.unionByName(answers)
    unknown = F.col("asks") & F.col("mid").isNull() & (F.col("direction") == "outgoing")
    for name, text in {"event": "unrouted_response", "detail": "missing message-id mapping", "source_id": None, "direction": "internal"}.items():
        rows = rows.withColumn(name, F.when(unknown, text).otherwise(F.col(name)))
    matched = F.col("asks") & F.col("mid").isNotNull()
    rows = rows.select(
        *LOG.fieldNames(),
        F.when(matched, F.col("mid")).otherwise(-1).alias("mid"),
        F.when(matched, 0).otherwise(1 + F.pmod(F.xxhash64("event_id"), F.lit(SPREAD))).cast("int").alias("part"),
    )
    return rows.groupBy("mid", "part").transformWithStateInPandas(
        ResponseLog(ttl_ms), LOG, outputMode="append", timeMode="processingTime" if ttl_ms else "none"
    )
