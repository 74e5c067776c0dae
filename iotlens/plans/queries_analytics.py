"""Queries: logs, counters, dataset quality, drift and score distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from iotlens.functions import text as X
from iotlens.functions.numeric import round6 as r6
from iotlens.functions.numeric import settled
from iotlens.operators import counters, detect, drift, quality, scores, vectors
from iotlens.operators import ranks as R
from iotlens.plans import oracle_base as B
from iotlens.plans.queries_packets import WITH_RESPONSES, responses
from iotlens.plans.registry import register
from iotlens.schemas import EVENT_LOG, FEATURE_LOG, FEATURES, SHARED, SNAPSHOT
from iotlens.sources import logs
from iotlens.sources.fixture import incoming, packet_events

q6 = B.round6


def _events(spark, sf):
    return packet_events(spark, sf).drop("payload")


def _clients(spark, sf):
    return incoming(_events(spark, sf))


def _scored(spark, sf):
    return detect.evaluate(vectors.behavioral_vector(_clients(spark, sf), detect.NEEDED_FEATURES))


def _scores(spark, sf):
    return _scored(spark, sf).select("protocol", F.col("anomaly_score").alias("score"))


def _behavioral(spark, sf):
    return vectors.behavioral_vector(incoming(packet_events(spark, sf)))


def _log(spark, sf):
    return detect.evaluate(vectors.both_vectors(incoming(packet_events(spark, sf))).select(
        "*", F.col("behavioral")[0].alias("f00"), F.col("behavioral")[2].alias("f02")
    ))


def _round(df, *names):
    return df.withColumns({n: r6(n) for n in names})


def _q(names) -> str:
    return ", ".join(f"{q6(n)} AS {n}" for n in names)


# ---- logs ----------------------------------------------------------------------------------


def _event_lines(spark, sf):
    """Log lines of all events; some are cut, some blank, some carry an unreadable size."""
    ev = _events(spark, sf)
    row = logs.event_log_rows(ev).columns
    fields = {c: F.col(c) for c in row if c not in ("ts", "bytes")}
    fields["ts"] = X.utc_stamp("t_us")
    fields["bytes"] = F.when(F.col("k") == 5, "abc").otherwise(F.col("bytes").cast("string"))
    text = F.to_json(F.struct(*[fields[c].alias(c) for c in row]))
    damaged = F.when(F.col("k") % 13 == 0, F.substring(text, 1, 20)).when(F.col("k") % 17 == 0, "  ").otherwise(text)
    return ev.select("event_id", damaged.alias("value"))


_GOOD = "NOT (k % 13 = 0) AND NOT (k % 17 = 0)"


@register(
    "event_log_read",
    B.WITH_EV + "SELECT event_id, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS ts, protocol, direction, event, "
    f"CASE WHEN k = 5 THEN 'abc' ELSE CAST(bytes AS VARCHAR) END AS bytes, detail FROM ev WHERE {_GOOD}",
)
def event_log_read(spark, sf):
    return logs.good(logs.parse_lines(_event_lines(spark, sf), EVENT_LOG))


@register("event_log_bad_lines", B.WITH_EV + "SELECT count(*) AS bad_lines, 20::BIGINT AS longest FROM ev WHERE k % 13 = 0")
def event_log_bad_lines(spark, sf):
    lines = logs.bad(logs.parse_lines(_event_lines(spark, sf), EVENT_LOG))
    return lines.agg(F.count(F.lit(1)).alias("bad_lines"), F.max(F.length("line")).cast("long").alias("longest"))


@register(
    "log_to_dataset",
    B.WITH_EV + "SELECT protocol, event, count(*) AS rows, CAST(sum(CASE WHEN k = 5 THEN 0 ELSE bytes END) AS BIGINT) AS bytes, "
    + q6("avg(" + B.clamp01("ln(1 + CASE WHEN k = 5 THEN 0.0 ELSE CAST(bytes AS DOUBLE) END) / ln(4097.0::DOUBLE)") + ")")
    + f" AS mean_f02 FROM ev WHERE {_GOOD} GROUP BY ALL",
)
def log_to_dataset(spark, sf):
    log = logs.good(logs.parse_lines(_event_lines(spark, sf), EVENT_LOG))
    run = {"run_id": F.lit("run-1"), "scenario": F.lit("live"), "label": F.lit("benign"), "rep": F.lit(1)}
    rows = vectors.dataset_rows(log.withColumns(run))
    return rows.groupBy("protocol", "event").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"), r6(F.avg("f02")).alias("mean_f02")
    )


@register(
    "feature_log_read",
    B.WITH_SCORED + f"SELECT event_id, protocol, source_id, action, reason, allow, {q6('anomaly_score')} AS anomaly_score, "
    f"{q6('f00')} AS active_f00, 33::INTEGER AS width FROM sc",
)
def feature_log_read(spark, sf):
    log = _log(spark, sf).select(
        "event_id", X.utc_stamp("t_us").alias("ts"), "protocol", "source_id", "legacy", "behavioral", "active",
        F.struct("allow", "action", "reason", "anomaly_score").alias("decision"),
    )
    lines = settled(log.select("event_id", F.struct(*log.columns[1:]).alias("row")), {"value": F.to_json("row")}).drop("row")
    rows = logs.good(logs.parse_lines(lines, FEATURE_LOG))
    return rows.select(
        "event_id", "protocol", "source_id", "decision.action", "decision.reason", "decision.allow",
        r6("decision.anomaly_score").alias("anomaly_score"), r6(F.col("active")[0]).alias("active_f00"),
        F.size("active").alias("width"),
    )


@register(
    "snapshot_defaults",
    B.WITH_EV + "SELECT event_id, CASE WHEN k % 2 = 0 THEN bytes ELSE 0 END AS mqtt_msgs, CASE WHEN k % 3 = 0 THEN CAST(k AS BIGINT) ELSE 0 END AS coap_msgs, "
    "0::BIGINT AS detections, 0::BIGINT AS latency_ms_p95 FROM ev",
)
def snapshot_defaults(spark, sf):
    k = F.col("k")
    body = F.to_json(F.struct(F.when(k % 2 == 0, F.col("bytes")).alias("mqtt_msgs"), F.when(k % 3 == 0, k).alias("coap_msgs")))
    lines = _events(spark, sf).select("event_id", body.alias("value"))
    parsed = logs.good(logs.parse_lines(lines, SNAPSHOT))
    return parsed.select("event_id", *[F.coalesce(F.col(f.name), F.lit(0)).cast("long").alias(f.name) for f in SNAPSHOT.fields])


@register(
    "event_tail",
    B.WITH_EV + "SELECT event_id, t_us, protocol, event, detail FROM ev ORDER BY t_us DESC, event_id DESC LIMIT 120",
)
def event_tail(spark, sf):
    return logs.event_tail(_events(spark, sf).select("event_id", "t_us", "protocol", "event", "detail"), 120)


@register(
    "recent_feed",
    B.WITH_EV + "SELECT event_id, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS ts, CASE WHEN contains(lower(label), 'detect') OR contains(lower(label), 'attack') "
    "OR contains(lower(label), 'anomal') THEN 'Detection' WHEN contains(lower(label), 'warn') THEN 'Warning' ELSE 'Info' END AS badge, detail AS message "
    "FROM ev ORDER BY t_us DESC, event_id DESC LIMIT 50",
)
def recent_feed(spark, sf):
    tail = logs.event_tail(_events(spark, sf).select("event_id", "t_us", "label", "detail"), 120)
    return logs.event_tail(tail, 50).select(
        "event_id", X.utc_stamp("t_us").alias("ts"), X.badge("label", F.lit(None).cast("string")).alias("badge"),
        X.feed_message("detail", F.lit(None).cast("string"), F.lit("")).alias("message"),
    )


@register(
    "runs_union",
    B.WITH_EV + "SELECT run_id, count(*) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM ev GROUP BY run_id",
)
def runs_union(spark, sf):
    rows = vectors.dataset_rows(_events(spark, sf))
    parts = [rows.filter(F.col("rep") == i) for i in range(3)]
    return logs.union_runs(*parts).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))


# ---- counters ------------------------------------------------------------------------------


def _framed(spark, sf):
    return _scored(spark, sf).withColumn("frames", F.col("k") % 3 + 1)


_COUNTERS = (
    "CAST(coalesce(sum(1 + k % 3) FILTER (allow AND protocol = 'mqtt'), 0) AS BIGINT) AS mqtt_msgs, "
    "count(*) FILTER (allow AND protocol = 'coap') AS coap_msgs, count(*) FILTER (NOT allow) AS detections"
)


@register("traffic_counters", B.WITH_SCORED + f"SELECT {_COUNTERS} FROM sc")
def traffic_counters(spark, sf):
    return counters.traffic_counters(_framed(spark, sf))


@register(
    "snapshot_1s",
    B.WITH_SCORED + f", s AS (SELECT t_us // 1000000 AS second, {_COUNTERS} FROM sc GROUP BY ALL) "
    "SELECT second, " + ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS {c}" for c in ("mqtt_msgs", "coap_msgs", "detections"))
    + " FROM s WINDOW w AS (ORDER BY second)",
)
def snapshot_1s(spark, sf):
    return counters.snapshots(_framed(spark, sf))


_P95 = "(list_sort(list({v})))[greatest(1, CAST(ceil(0.95::DOUBLE * count({v})) AS BIGINT))]"


@register(
    "feature_stats",
    B.WITH_SCORED + ", l AS (SELECT CASE WHEN k = 7 THEN 'http' ELSE protocol END AS p, CASE WHEN k = 8 THEN NULL ELSE anomaly_score END AS s FROM sc) "
    "SELECT count(*) AS total_vectors, count(*) FILTER (p = 'mqtt') AS mqtt, count(*) FILTER (p = 'coap') AS coap, count(*) FILTER (p NOT IN ('mqtt', 'coap')) AS unknown, "
    f"{q6('min(s)')} AS min, {q6('max(s)')} AS max, {q6('avg(s)')} AS mean, {q6('(SELECT ' + _P95.format(v='s') + ' FROM l WHERE s IS NOT NULL)')} AS p95 FROM l",
)
def feature_stats(spark, sf):
    k = F.col("k")
    log = _scored(spark, sf).select(
        F.when(k == 7, "http").otherwise(F.col("protocol")).alias("protocol"),
        F.when(k != 8, F.col("anomaly_score")).alias("score"),
    )
    return _round(counters.feature_stats(log), "min", "max", "mean", "p95")


@register(
    "kpi_shares",
    B.WITH_SCORED + f", c AS (SELECT {_COUNTERS} FROM sc) SELECT mqtt_msgs + coap_msgs AS total_msgs, "
    + ", ".join(f"{q6(f'{c} * 100.0::DOUBLE / (mqtt_msgs + coap_msgs)')} AS {n}" for c, n in
                (("mqtt_msgs", "mqtt_pct"), ("coap_msgs", "coap_pct"), ("detections", "detection_pct"))) + " FROM c",
)
def kpi_shares(spark, sf):
    shares = counters.kpi_shares(counters.traffic_counters(_framed(spark, sf)))
    return _round(shares, "mqtt_pct", "coap_pct", "detection_pct")


@register(
    "coverage",
    B.WITH_EV + "SELECT 'all' AS kind, 'all' AS name, count(*) AS rows, count(DISTINCT run_id) AS runs FROM ev UNION ALL "
    "SELECT 'protocol', protocol, count(*), count(DISTINCT run_id) FROM ev GROUP BY protocol UNION ALL "
    "SELECT 'label', label, count(*), count(DISTINCT run_id) FROM ev GROUP BY label",
)
def coverage(spark, sf):
    return counters.coverage(_events(spark, sf))


@register(
    "capture_counts",
    B.WITH_SCORED + "SELECT count(*) AS rows, count(*) FILTER (protocol = 'mqtt') AS mqtt_rows, count(*) FILTER (protocol = 'coap') AS coap_rows, "
    "count(*) FILTER (k % 2 = 0) AS behavioral_rows, count(DISTINCT protocol) AS protocols FROM sc",
)
def capture_counts(spark, sf):
    return counters.capture_counts(_clients(spark, sf).withColumn("behavioral_enabled", F.col("k") % 2 == 0))


def _lat(v: str, n: str) -> str:
    return (
        f"count({v}) AS samples, min({v}) AS min, (list_sort(list({v})))[{n} // 2 + 1] AS p50, "
        f"(list_sort(list({v})))[CAST(floor({n} * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, "
        f"(list_sort(list({v})))[CAST(floor({n} * 0.99::DOUBLE) AS BIGINT) + 1] AS p99, max({v}) AS max, {q6(f'avg({v})')} AS mean"
    )


@register(
    "latency_summary",
    WITH_RESPONSES + ", l AS (SELECT CASE WHEN routed THEN t_us - prev_us END AS v, src % 2 = 1 AND src % 4 = 1 AS early FROM resp), "
    "g AS (SELECT early, count(*) FILTER (v IS NULL) AS errors FROM l GROUP BY early), "
    f"s AS (SELECT early, {_lat('v', 'count(v)')} FROM l WHERE v IS NOT NULL GROUP BY early) "
    "SELECT s.*, g.errors FROM s JOIN g USING (early)",
)
def latency_summary(spark, sf):
    r = responses(spark, sf).withColumn("early", (F.col("src") % 2 == 1) & (F.col("src") % 4 == 1))
    return _round(counters.latency_summary(r, "latency_us", ["early"]), "mean")


@register(
    "latency_p95_gauge",
    WITH_RESPONSES + " SELECT (list_sort(list(t_us - prev_us)))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] / 1000.0 AS latency_ms_p95 FROM resp WHERE routed",
)
def latency_p95_gauge(spark, sf):
    p95 = R.order_statistics(
        responses(spark, sf), [], "latency_us", {"us": R.at_rank(R.floor_rank(0.95), "latency_us")}
    )
    return p95.select((F.col("us") / 1000.0).alias("latency_ms_p95"))


@register(
    "latency_linear",
    WITH_RESPONSES + ", l AS (SELECT CAST(t_us - prev_us AS DOUBLE) AS v FROM resp WHERE routed) SELECT "
    + ", ".join(f"{q6(e)} AS {n}" for n, e in {
        "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "p95": "quantile_cont(v, 0.95)", "p99": "quantile_cont(v, 0.99)", "min": "min(v)", "max": "max(v)",
    }.items()) + " FROM l",
)
def latency_linear(spark, sf):
    r = responses(spark, sf).select(F.col("latency_us").cast("double").alias("latency_us"))
    return _round(counters.latency_linear(r, "latency_us"), "mean", "median", "p95", "p99", "min", "max")


def _overhead_sql() -> str:
    metric = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(d.{m} AS DOUBLE) AS a, CAST(p.{m} AS DOUBLE) AS b FROM d, p" for m in counters.LATENCY_METRICS
    )
    return (
        WITH_RESPONSES + ", l AS (SELECT t_us - prev_us AS v, src % 4 = 1 AS direct FROM resp WHERE routed), "
        f"d AS (SELECT {_lat('v', 'count(v)')} FROM l WHERE direct), p AS (SELECT {_lat('v', 'count(v)')} FROM l WHERE NOT direct) "
        f"SELECT metric, {q6('a')} AS direct_ms, {q6('b')} AS proxy_ms, {q6('b - a')} AS overhead_ms, "
        f"{q6('CASE WHEN a > 0 THEN (b - a) / a * 100.0 ELSE 0.0 END')} AS overhead_pct FROM ({metric})"
    )


@register("path_overhead", _overhead_sql())
def path_overhead(spark, sf):
    r = responses(spark, sf).filter(F.col("routed")).withColumn("direct", F.col("src") % 4 == 1)
    both = _round(counters.latency_summary(r, "latency_us", ["direct"]), "mean")
    compared = counters.path_overhead(both.filter(F.col("direct")), both.filter(~F.col("direct")))
    return _round(compared, "direct_ms", "proxy_ms", "overhead_ms", "overhead_pct")


@register(
    "throughput",
    WITH_RESPONSES + " SELECT count(*) AS total, count(*) FILTER (NOT routed) AS failures, (max(t_us) - min(t_us)) / 1e6 AS elapsed_s, "
    + ", ".join(f"{q6(f'coalesce({f}(CASE WHEN routed THEN CAST(t_us - prev_us AS DOUBLE) END), 0)')} AS {f}_latency" for f in ("avg", "min", "max"))
    + f", {q6('count(*) / ((max(t_us) - min(t_us)) / 1e6)')} AS avg_rate FROM resp",
)
def throughput(spark, sf):
    out = counters.throughput(responses(spark, sf), failed=~F.col("routed"), value="latency_us")
    return _round(out, "avg_latency", "min_latency", "max_latency", "avg_rate")


@register(
    "rate_by_second",
    B.WITH_EV + ", s AS (SELECT protocol, source_id, t_us // 1000000 AS second, count(*) AS messages FROM ev GROUP BY ALL) "
    "SELECT *, messages - coalesce(lag(messages) OVER (PARTITION BY protocol, source_id ORDER BY second), 0) AS change FROM s",
)
def rate_by_second(spark, sf):
    return counters.rate_by_second(_events(spark, sf), ["protocol", "source_id"])


# ---- dataset quality -----------------------------------------------------------------------


def _spoiled(spark, sf):
    """Dataset rows where some one-hot pairs are swapped and some values leave [0, 1]."""
    rows = vectors.legacy_vector(_events(spark, sf))
    k = F.col("k")
    return rows.withColumns(
        {"f15": F.when(k == 3, F.col("f16")).otherwise(F.col("f15")), "f02": F.when(k == 4, F.col("f02") + 1.0).otherwise(F.col("f02")),
         "f13": F.when(k % 7 == 4, F.col("f13") - 1.0).otherwise(F.col("f13"))}
    )


@register("onehot_violations", B.WITH_EV + "SELECT count(*) FILTER (k = 3) AS violations, count(*) AS rows FROM ev")
def onehot_violations(spark, sf):
    return quality.onehot_violations(_spoiled(spark, sf))


@register(
    "range_violations",
    B.WITH_LEGACY + ", v AS (SELECT * REPLACE (CASE WHEN k = 4 THEN f02 + 1.0 ELSE f02 END AS f02, CASE WHEN k % 7 = 4 THEN f13 - 1.0 ELSE f13 END AS f13) "
    f"FROM lv JOIN (SELECT event_id, k FROM ev) USING (event_id)) SELECT feature, count(*) FILTER (value < 0 OR value > 1) AS out_of_range "
    f"FROM (UNPIVOT (SELECT {', '.join(SHARED)} FROM v) ON {', '.join(SHARED)} INTO NAME feature VALUE value) GROUP BY feature",
)
def range_violations(spark, sf):
    return quality.range_violations(_spoiled(spark, sf)).orderBy(F.desc("out_of_range"), "feature")


_SUMMARY = (
    'count(*) AS "count", ' + ", ".join(f"{q6(e)} AS {n}" for n, e in {
        "min": "min(value)", "p25": "quantile_cont(value, 0.25)", "median": "quantile_cont(value, 0.5)", "p75": "quantile_cont(value, 0.75)",
        "max": "max(value)", "mean": "avg(value)", "std": "stddev_pop(value)",
    }.items())
)
_LONG = f"(UNPIVOT (SELECT protocol, {', '.join(FEATURES)} FROM bv) ON {', '.join(FEATURES)} INTO NAME feature VALUE value)"
_SUM_COLS = ["min", "p25", "median", "p75", "max", "mean", "std"]


@register("feature_summary", B.WITH_BEHAVIORAL + f"SELECT feature, {_SUMMARY} FROM {_LONG} GROUP BY feature")
def feature_summary(spark, sf):
    return _round(quality.feature_summary(_behavioral(spark, sf)), *_SUM_COLS)


@register("feature_summary_by_protocol", B.WITH_BEHAVIORAL + f"SELECT protocol, feature, {_SUMMARY} FROM {_LONG} GROUP BY protocol, feature")
def feature_summary_by_protocol(spark, sf):
    return _round(quality.feature_summary(_behavioral(spark, sf), ["protocol"]), *_SUM_COLS)


_BIN = "CAST(least(floor(greatest(0.0, least(value, 1.0)) * 20), 19) AS INTEGER)"
_CLASS = (
    "CASE WHEN label = 'benign' THEN 'benign' WHEN contains(label, 'flood') THEN 'flood' "
    "WHEN contains(label, 'protocol_abuse') THEN 'protocol_abuse' WHEN contains(label, 'wildcard') THEN 'wildcard' ELSE 'other' END"
)
_LONG15 = (
    f"(UNPIVOT (SELECT protocol, {_CLASS} AS attack_class, {', '.join(SHARED)} FROM bv) ON {', '.join(SHARED)} INTO NAME feature VALUE value)"
)


@register(
    "histogram20",
    B.WITH_BEHAVIORAL + f", h AS (SELECT protocol, feature, {_BIN} AS bin, count(*) AS n FROM {_LONG15} GROUP BY ALL) "
    f"SELECT protocol, feature, bin, n, CAST(sum(n) OVER (PARTITION BY protocol, feature) AS BIGINT) AS rows, "
    f"{q6('n / sum(n) OVER (PARTITION BY protocol, feature)')} AS share FROM h",
)
def histogram20(spark, sf):
    return _round(quality.histogram(_behavioral(spark, sf), ["protocol"]), "share")


_KL = (
    B.WITH_BEHAVIORAL + f", h AS (SELECT attack_class, feature, {_BIN} AS bin, count(*) FILTER (protocol = 'mqtt') AS m, "
    f"count(*) FILTER (protocol = 'coap') AS c FROM {_LONG15} GROUP BY ALL), "
    "t AS (SELECT *, sum(m) OVER w AS mt, sum(c) OVER w AS ct FROM h WINDOW w AS (PARTITION BY attack_class, feature)), "
    "pq AS (SELECT *, m / mt + 1e-12 AS p, c / ct + 1e-12 AS q FROM t WHERE mt > 0 AND ct > 0), "
    "kl AS (SELECT attack_class, feature, CAST(max(mt) AS BIGINT) AS mqtt_count, CAST(max(ct) AS BIGINT) AS coap_count, sum(p * ln(p / q)) AS kl_mqtt_to_coap, "
    "sum(q * ln(q / p)) AS kl_coap_to_mqtt, (sum(p * ln(p / q)) + sum(q * ln(q / p))) * 0.5 AS kl_symmetric FROM pq GROUP BY ALL) "
)


@register("kl_alignment", _KL + "SELECT attack_class, feature, mqtt_count, coap_count, " + _q(["kl_mqtt_to_coap", "kl_coap_to_mqtt", "kl_symmetric"]) + " FROM kl")
def kl_alignment(spark, sf):
    return _round(quality.kl_alignment(_behavioral(spark, sf)), "kl_mqtt_to_coap", "kl_coap_to_mqtt", "kl_symmetric")


@register("kl_by_class", _KL + f"SELECT attack_class, {q6('avg(kl_symmetric)')} AS mean_kl FROM kl GROUP BY attack_class")
def kl_by_class(spark, sf):
    return _round(quality.kl_by_class(quality.kl_alignment(_behavioral(spark, sf))), "mean_kl")


@register(
    "kl_ranking",
    _KL + "SELECT feature, " + ", ".join(f"{q6(f'''avg(kl_symmetric) FILTER (attack_class = '{c}')''')} AS {c}" for c in quality.CLASSES)
    + f", {q6('avg(kl_symmetric)')} AS mean_kl FROM kl GROUP BY feature",
)
def kl_ranking(spark, sf):
    return _round(quality.kl_ranking(quality.kl_alignment(_behavioral(spark, sf))), *quality.CLASSES, "mean_kl")


# ---- drift ---------------------------------------------------------------------------------

_DRIFT = (
    B.WITH_BOTH + ", pairs AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, l.{f} AS a, b.{f} AS b FROM bv b JOIN lv l USING (event_id)" for f in FEATURES)
    + "), dr AS (SELECT feature, avg(a) AS legacy_mean, stddev_pop(a) AS legacy_std, avg(b) AS behavioral_mean, stddev_pop(b) AS behavioral_std, "
    "avg(abs(b - a)) AS drift_mean, max(abs(b - a)) AS drift_max FROM pairs GROUP BY feature) "
)
_DRIFT_COLS = ["legacy_mean", "legacy_std", "behavioral_mean", "behavioral_std", "drift_mean", "drift_max"]


def _drift(spark, sf):
    return drift.drift(vectors.both_vectors(incoming(packet_events(spark, sf))))


@register("drift", _DRIFT + f"SELECT feature, {_q(_DRIFT_COLS)} FROM dr")
def drift_query(spark, sf):
    return _round(_drift(spark, sf), *_DRIFT_COLS)


@register("drift_top5", _DRIFT + f"SELECT feature, {q6('drift_mean')} AS drift_mean FROM dr ORDER BY dr.drift_mean DESC, feature LIMIT 5")
def drift_top5(spark, sf):
    return _round(drift.top_drift(_drift(spark, sf)).select("feature", "drift_mean"), "drift_mean")


@register(
    "drift_bands",
    _DRIFT + f"SELECT feature, {q6('drift_mean')} AS drift_mean, CASE WHEN dr.drift_mean > 0.4 THEN 'high' WHEN dr.drift_mean > 0.2 THEN 'moderate' ELSE 'low' END AS band, "
    "abs(legacy_mean - behavioral_mean) > 0.35 AS off_diagonal FROM dr",
)
def drift_bands(spark, sf):
    return _round(drift.drift_bands(_drift(spark, sf)), "drift_mean")


@register(
    "row_drift_tail",
    B.WITH_BOTH + "SELECT " + q6("avg(d)") + " AS avg_delta, count(*) AS samples FROM (SELECT ("
    + " + ".join(f"abs(b.{f} - l.{f})" for f in FEATURES) + ") / 33 AS d FROM bv b JOIN lv l USING (event_id) ORDER BY b.t_us DESC, b.event_id DESC LIMIT 10)",
)
def row_drift_tail(spark, sf):
    return _round(drift.tail_drift(vectors.both_vectors(incoming(packet_events(spark, sf)))), "avg_delta")


# ---- scores --------------------------------------------------------------------------------


@register(
    "score_distribution",
    B.WITH_SCORED + ", s AS (SELECT protocol, anomaly_score AS v FROM sc UNION ALL SELECT 'all', anomaly_score FROM sc), "
    "g AS (SELECT protocol, list_sort(list(v)) AS l, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM s GROUP BY protocol) "
    f"SELECT protocol, n AS \"count\", {q6('l[1]')} AS min, {q6('l[n]')} AS max, {q6('mean')} AS mean, "
    f"{q6('(l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2')} AS median, {q6('sd')} AS stdev, {q6('l[n // 4 + 1]')} AS p25, "
    f"{q6('l[3 * n // 4 + 1]')} AS p75, {q6('l[CAST(floor(0.95::DOUBLE * n - 1) AS BIGINT) + 1]')} AS p95 FROM g",
)
def score_distribution(spark, sf):
    return _round(scores.distribution(_scores(spark, sf)), "min", "max", "mean", "median", "stdev", "p25", "p75", "p95")


@register(
    "score_bands",
    B.WITH_SCORED + "SELECT protocol, count(*) AS \"count\", " + ", ".join(f"{q6(e)} AS {n}" for n, e in {
        "benign_ratio": "avg(CASE WHEN anomaly_score < 0.3 THEN 1.0::DOUBLE ELSE 0 END)",
        "elevated_ratio": "avg(CASE WHEN anomaly_score >= 0.3 AND anomaly_score < 0.75 THEN 1.0::DOUBLE ELSE 0 END)",
        "suspicious_ratio": "avg(CASE WHEN anomaly_score >= 0.75 THEN 1.0::DOUBLE ELSE 0 END)",
        "anomaly_mean": "avg(anomaly_score)", "anomaly_stdev": "stddev_samp(anomaly_score)",
    }.items()) + " FROM sc GROUP BY protocol",
)
def score_bands(spark, sf):
    return _round(scores.bands(_scores(spark, sf)), "benign_ratio", "elevated_ratio", "suspicious_ratio", "anomaly_mean", "anomaly_stdev")


@register(
    "score_stats",
    B.WITH_SCORED + "SELECT protocol, count(*) AS n, " + ", ".join(f"{q6(e)} AS {n}" for n, e in {
        "mean": "avg(anomaly_score)", "median": "quantile_cont(anomaly_score, 0.5)", "std": "stddev_pop(anomaly_score)", "min": "min(anomaly_score)",
        "max": "max(anomaly_score)", "p75": "quantile_cont(anomaly_score, 0.75)", "p95": "quantile_cont(anomaly_score, 0.95)",
        "threshold_075_rate": "avg(CASE WHEN anomaly_score >= 0.75 THEN 1.0::DOUBLE ELSE 0 END)",
    }.items()) + ", count(*) FILTER (anomaly_score >= 0.75) AS threshold_075_flagged FROM sc GROUP BY protocol",
)
def score_stats(spark, sf):
    return _round(scores.statistics(_scores(spark, sf)), "mean", "median", "std", "min", "max", "p75", "p95", "threshold_075_rate")


_STEP = repr((scores.SWEEP_LAST - scores.SWEEP_FIRST) / (scores.SWEEP_STEPS - 1))


@register(
    "threshold_sweep",
    B.WITH_SCORED + f", th AS (SELECT 0.1::DOUBLE + i * {_STEP}::DOUBLE AS threshold FROM range(200) r(i)) "
    f"SELECT {q6('threshold')} AS threshold, {q6('count(*) FILTER (anomaly_score >= threshold) / count(*)')} AS detection_rate, "
    f"{q6('coalesce(count(*) FILTER (anomaly_score >= threshold AND anomaly_score < 0.4) / nullif(count(*) FILTER (anomaly_score < 0.4), 0), 0.0)')} AS false_alarm_rate "
    "FROM sc, th GROUP BY threshold",
)
def threshold_sweep(spark, sf):
    return _round(scores.threshold_sweep(spark, _scores(spark, sf)), "threshold", "detection_rate", "false_alarm_rate")


@register(
    "score_density",
    B.WITH_SCORED + ", h AS (SELECT protocol, CAST(least(floor(anomaly_score * 29), 28) AS BIGINT) AS bin, count(*) AS n FROM sc GROUP BY ALL), "
    "t AS (SELECT protocol, sum(n) AS total FROM h GROUP BY protocol) "
    f"SELECT t.protocol, b.bin, {q6('coalesce(h.n, 0) * 29 / t.total')} AS density FROM t CROSS JOIN (SELECT range AS bin FROM range(29)) b LEFT JOIN h ON h.protocol = t.protocol AND h.bin = b.bin",
)
def score_density(spark, sf):
    return _round(scores.density(spark, _scores(spark, sf)), "density")


@register(
    "score_kde",
    B.WITH_SCORED + ", m AS (SELECT protocol, count(*) AS n, stddev_samp(anomaly_score) * 0.3::DOUBLE AS h FROM sc GROUP BY protocol) "
    f"SELECT protocol, CAST(i AS INTEGER) AS point, {q6(f'sum(exp(((i / 299.0::DOUBLE - anomaly_score) / h) * ((i / 299.0::DOUBLE - anomaly_score) / h) * -0.5) / (h * {math.sqrt(2 * math.pi)!r}::DOUBLE)) / max(n)')} AS density "
    "FROM sc JOIN m USING (protocol) CROSS JOIN range(300) g(i) WHERE n > 3 GROUP BY protocol, i",
)
def score_kde(spark, sf):
    return _round(scores.kernel_density(_scores(spark, sf)), "density")


@register(
    "box_stats",
    B.WITH_SCORED + ", b AS (SELECT protocol, quantile_cont(anomaly_score, 0.25) AS q1, quantile_cont(anomaly_score, 0.5) AS median, quantile_cont(anomaly_score, 0.75) AS q3 FROM sc GROUP BY protocol), "
    "j AS (SELECT sc.protocol, anomaly_score AS v, q1, median, q3, anomaly_score BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS ok FROM sc JOIN b USING (protocol)) "
    f"SELECT protocol, {q6('max(q1)')} AS q1, {q6('max(median)')} AS median, {q6('max(q3)')} AS q3, {q6('min(v) FILTER (ok)')} AS low_whisker, {q6('max(v) FILTER (ok)')} AS high_whisker, "
    "count(*) FILTER (NOT ok) AS outliers FROM j GROUP BY protocol",
)
def box_stats(spark, sf):
    return _round(scores.box_stats(_scores(spark, sf)), "q1", "median", "q3", "low_whisker", "high_whisker")


@register(
    "attack_catch",
    B.WITH_SCORED + "SELECT count(*) AS rows, count(*) FILTER (anomaly_score > 0.75) AS caught FROM (SELECT * FROM sc ORDER BY t_us DESC, event_id DESC LIMIT 500)",
)
def attack_catch(spark, sf):
    return scores.caught(_scored(spark, sf).select("t_us", "event_id", "anomaly_score"), 500)



