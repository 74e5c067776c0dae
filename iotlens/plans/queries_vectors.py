"""Queries: scalar functions, vectors, per-source state and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from iotlens.functions import detail as D
from iotlens.functions import entropy as E
from iotlens.functions import numeric as N
from iotlens.functions import text as X
from iotlens.operators import detect, state, vectors
from iotlens.plans import oracle_base as B
from iotlens.plans.registry import register
from iotlens.schemas import FEATURES
from iotlens.settings import Detection, Slots
from iotlens.sources.fixture import incoming, packet_events

r6 = N.round6
q6 = B.round6


def _events(spark, sf):
    return packet_events(spark, sf).drop("payload")


def _clients(spark, sf):
    return incoming(_events(spark, sf))


def _scored(spark, sf):
    return detect.evaluate(vectors.behavioral_vector(_clients(spark, sf), detect.NEEDED_FEATURES))


# ---- scalars ------------------------------------------------------------------------------


@register(
    "clamp_norm",
    B.WITH_EV + f"SELECT event_id, {q6(B.clamp01('(bytes - 300) / 1000.0'))} AS clamped, "
    f"{q6(B.clamp01('bytes / 2048.0'))} AS share, 0.0::DOUBLE AS no_cap FROM ev",
)
def clamp_norm(spark, sf):
    b = F.col("bytes")
    return _events(spark, sf).select(
        "event_id",
        r6(N.clamp01((b - 300) / 1000.0)).alias("clamped"),
        r6(N.norm(b, F.lit(2048.0))).alias("share"),
        N.norm(b, 0.0).alias("no_cap"),
    )


@register(
    "tag_values",
    B.WITH_EV + f"SELECT event_id, {B.tag('topic:')} AS topic, {B.tag('path:')} AS path, {B.tag('token:')} AS token, "
    f"{B.tag('client_id:')} AS client_id, {B.tag('qos:')} AS qos FROM ev",
)
def tag_values(spark, sf):
    return _events(spark, sf).select(
        "event_id", *[X.tag_value("detail", f"{n}:").alias(n) for n in ("topic", "path", "token", "client_id", "qos")]
    )


@register(
    "byte_entropy",
    "WITH h AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), "
    "c AS (SELECT doc_id, b, count(*) AS n FROM h GROUP BY ALL), "
    "t AS (SELECT doc_id, sum(n) AS total, sum(n * log2(n)) AS weighted FROM c GROUP BY doc_id) "
    "SELECT d.doc_id, CAST(octet_length(encode(d.text)) AS BIGINT) AS n_bytes, "
    f"{q6('greatest(0.0::DOUBLE, coalesce(log2(t.total) - t.weighted / t.total, 0.0::DOUBLE))')} AS entropy_bits "
    "FROM documents d LEFT JOIN t USING (doc_id)",
)
def byte_entropy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    payload = F.encode("text", "UTF-8")
    return docs.select(
        "doc_id", F.octet_length(payload).cast("long").alias("n_bytes"), r6(E.byte_entropy(payload)).alias("entropy_bits")
    )


@register(
    "page_entropy",
    "WITH h AS (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS b FROM pages), "
    "c AS (SELECT page_id, b, count(*) AS n FROM h GROUP BY ALL), "
    "t AS (SELECT page_id, sum(n) AS total, sum(n * log2(n)) AS weighted FROM c GROUP BY page_id) "
    f"SELECT p.page_id, {q6('greatest(0.0::DOUBLE, coalesce(log2(t.total) - t.weighted / t.total, 0.0::DOUBLE)) / 8.0')} AS f03 "
    "FROM pages p LEFT JOIN t USING (page_id)",
)
def page_entropy(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", r6(N.clamp01(E.byte_entropy(F.encode("html", "UTF-8")) / 8.0)).alias("f03"))


@register(
    "string_entropy",
    B.WITH_FLAGS + f"SELECT event_id, {q6(B.entropy('source_id'))} AS source_bits, {q6(B.entropy('resource'))} AS resource_bits, "
    f"{q6(B.clamp01(B.entropy('source_id') + ' / 4.0'))} AS source_share FROM flags",
)
def string_entropy(spark, sf):
    return _events(spark, sf).select(
        "event_id",
        r6(E.text_entropy("source_id")).alias("source_bits"),
        r6(E.text_entropy(D.resource("detail"))).alias("resource_bits"),
        r6(E.text_entropy_unit("source_id")).alias("source_share"),
    )


@register(
    "resource_depth",
    B.WITH_FLAGS + f"SELECT event_id, resource, {q6(B.BEHAVIORAL_EXPR['f04'])} AS depth FROM flags",
)
def resource_depth(spark, sf):
    res = D.resource("detail")
    return _events(spark, sf).select("event_id", res.alias("resource"), r6(X.resource_depth(res)).alias("depth"))


@register(
    "log_size",
    B.WITH_FLAGS + f"SELECT event_id, {q6(B.BEHAVIORAL_EXPR['f02'])} AS size_share, {q6(B.BEHAVIORAL_EXPR['f13'])} AS per_resource FROM flags",
)
def log_size(spark, sf):
    return _events(spark, sf).select(
        "event_id",
        r6(N.log_size("bytes")).alias("size_share"),
        r6(N.size_per_resource("bytes", F.octet_length(D.resource("detail")))).alias("per_resource"),
    )


_NUM_TEXT = "CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN CAST(bytes AS VARCHAR) WHEN 1 THEN ' ' || k || '.5 ' WHEN 2 THEN 'n/a' WHEN 3 THEN k || 'abc' WHEN 4 THEN '' ELSE '-' || k END"


@register(
    "to_float",
    B.WITH_EV + f"SELECT event_id, coalesce(try_cast(trim({_NUM_TEXT}) AS DOUBLE), 0.0) AS value FROM ev",
)
def to_float(spark, sf):
    return _events(spark, sf).select("event_id", N.to_float(_number_text()).alias("value"))


def _number_text():
    k = F.col("k").cast("string")
    kind = F.col("event_id") % 6
    return (
        F.when(kind == 0, F.col("bytes").cast("string"))
        .when(kind == 1, F.concat(F.lit(" "), k, F.lit(".5 ")))
        .when(kind == 2, "n/a")
        .when(kind == 3, F.concat(k, F.lit("abc")))
        .when(kind == 4, "")
        .otherwise(F.concat(F.lit("-"), k))
    )


@register(
    "prefix_float",
    B.WITH_EV + "SELECT event_id, coalesce(try_cast(regexp_extract(" + _NUM_TEXT + ", '^\\s*([-+]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE), 60.0) AS value FROM ev",
)
def prefix_float(spark, sf):
    return _events(spark, sf).select("event_id", N.prefix_float(_number_text(), 60.0).alias("value"))


@register(
    "unit_setting",
    B.WITH_EV + f"SELECT event_id, CASE WHEN {_NUM_TEXT} = trim({_NUM_TEXT}) AND try_cast({_NUM_TEXT} AS DOUBLE) BETWEEN 0 AND 1 "
    f"THEN try_cast({_NUM_TEXT} AS DOUBLE) ELSE 0.75 END AS value FROM ev",
)
def unit_setting(spark, sf):
    return _events(spark, sf).select("event_id", N.unit_or(_number_text(), 0.75).alias("value"))


@register(
    "utc_stamp",
    B.WITH_EV + "SELECT event_id, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS stamp, "
    "strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stamp_micros, t_us // 1000000 * 1000000 AS parsed_us FROM ev",
)
def utc_stamp(spark, sf):
    stamped = _events(spark, sf).select(
        "event_id", X.utc_stamp("t_us").alias("stamp"), X.utc_stamp_micros("t_us").alias("stamp_micros")
    )
    return stamped.withColumn("parsed_us", X.stamp_micros("stamp"))


@register(
    "text_normalise",
    B.WITH_EV + "SELECT event_id, lower(trim('  ' || upper(detail) || ' ')) AS detail, lower(trim(upper(protocol))) AS protocol FROM ev",
)
def text_normalise(spark, sf):
    messy = F.concat(F.lit("  "), F.upper("detail"), F.lit(" "))
    return _events(spark, sf).select(
        "event_id", X.normalise(messy).alias("detail"), X.normalise(F.upper("protocol")).alias("protocol")
    )


@register("qos_level", B.WITH_FLAGS + f"SELECT event_id, {B.BEHAVIORAL_EXPR['f06']} AS qos_level FROM flags")
def qos_level(spark, sf):
    return _events(spark, sf).select("event_id", D.qos_level("protocol", "detail").alias("qos_level"))


_MARKED = "detail || CASE WHEN k % 4 = 0 THEN '|filter:site/+/dev/#' ELSE '' END"


@register(
    "wildcard_ratio",
    B.WITH_EV + f"SELECT event_id, least(1.0::DOUBLE, (length({_MARKED}) - length(translate({_MARKED}, '#+', ''))) / 4.0::DOUBLE) AS ratio FROM ev",
)
def wildcard_ratio(spark, sf):
    marked = F.concat("detail", F.when(F.col("k") % 4 == 0, "|filter:site/+/dev/#").otherwise(""))
    return _events(spark, sf).select("event_id", X.wildcard_ratio(marked).alias("ratio"))


_CLASS = (
    "CASE WHEN lower(trim(label)) = 'benign' THEN 'benign' WHEN contains(lower(label), 'flood') THEN 'flood' "
    "WHEN contains(lower(label), 'protocol_abuse') THEN 'protocol_abuse' WHEN contains(lower(label), 'wildcard') THEN 'wildcard' ELSE 'other' END"
)


@register("canonical_class", B.WITH_EV + f"SELECT event_id, label, {_CLASS} AS attack_class FROM ev")
def canonical_class(spark, sf):
    return _events(spark, sf).select("event_id", "label", X.attack_class("label").alias("attack_class"))


@register(
    "detail_flags",
    B.WITH_FLAGS
    + "SELECT event_id, split_part(detail, '|', 1) AS route, resource, is_error, is_breadth, is_open AS is_reconnect, "
    "(is_open OR is_qos2 OR is_ack OR is_con) AS is_handshake, "
    "CASE WHEN is_con THEN 'con' WHEN is_non THEN 'non' WHEN is_ack THEN 'ack' WHEN is_rst THEN 'rst' END AS coap_type, "
    f"try_cast(nullif({B.tag('qos:')}, '') AS INTEGER) AS qos, {B.tag('client_id:')} AS client_id, {B.tag('token:')} AS token, "
    "keepalive_s, opt_count, contains(detail, 'retain') AS retain, contains(detail, 'wildcard') AS wildcard, "
    "contains(detail, 'will') AS will, contains(detail, 'malform') AS malform, is_qos2 AS qos2_flow, "
    "contains(detail, 'observe') AS observe, contains(detail, 'blockwise') AS blockwise, contains(detail, 'discovery') AS discovery FROM flags",
)
def detail_flags(spark, sf):
    return _events(spark, sf).select("event_id", *[c.alias(n) for n, c in D.parsed_columns().items()])


@register(
    "event_badge",
    B.WITH_EV
    + "SELECT event_id, CASE WHEN contains(t, 'detect') OR contains(t, 'attack') OR contains(t, 'anomal') THEN 'Detection' "
    "WHEN contains(t, 'warn') THEN 'Warning' ELSE 'Info' END AS badge, coalesce(msg, message, 'id=' || event_id) AS message FROM ("
    "SELECT event_id, lower(coalesce(CASE WHEN k % 3 = 0 THEN label END, CASE WHEN k % 2 = 0 THEN 'WARNING' ELSE 'anomaly-' || event END)) AS t, "
    "CASE WHEN k % 3 = 0 THEN detail END AS msg, CASE WHEN k % 3 = 1 THEN event END AS message FROM ev)",
)
def event_badge(spark, sf):
    k = F.col("k")
    kind = F.when(k % 3 == 0, F.col("label"))
    level = F.when(k % 2 == 0, "WARNING").otherwise(F.concat(F.lit("anomaly-"), F.col("event")))
    msg, message = F.when(k % 3 == 0, F.col("detail")), F.when(k % 3 == 1, F.col("event"))
    whole = F.concat(F.lit("id="), F.col("event_id").cast("string"))
    return _events(spark, sf).select(
        "event_id", X.badge(kind, level).alias("badge"), X.feed_message(msg, message, whole).alias("message")
    )


@register(
    "score_from_outputs",
    B.WITH_EV
    + f"SELECT event_id, CASE WHEN k % 5 = 0 THEN 0.0::DOUBLE WHEN k % 2 = 0 THEN {q6('greatest(k / 100.0, 1.0 - k / 100.0)')} "
    f"ELSE {q6('1.0 / (1.0 + exp(-greatest(k / 10.0 - 5.0, 1.5 - k / 50.0, -1.0)))')} END AS score FROM ev",
)
def score_from_outputs(spark, sf):
    k = F.col("k").cast("double")
    outputs = (
        F.when(F.col("k") % 5 == 0, F.array().cast("array<double>"))
        .when(F.col("k") % 2 == 0, F.array(k / 100.0, F.lit(1.0) - k / 100.0))
        .otherwise(F.array(k / 10.0 - 5.0, F.lit(1.5) - k / 50.0, F.lit(-1.0)))
    )
    return _events(spark, sf).select("event_id", r6(N.score_from_outputs(outputs)).alias("score"))


def _p_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0 / (1.0 + {N.ERF_P}::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for a in reversed(N.ERF_COEFFICIENTS):
        poly = f"(({poly} + {a}::DOUBLE) * {t})"
    return f"({poly} * exp(-{x} * {x}))"


@register("normal_p", B.WITH_EV + f"SELECT event_id, {q6(_p_sql('((bytes - 400) / 150.0::DOUBLE)'))} AS p_value FROM ev")
def normal_p(spark, sf):
    return _events(spark, sf).select("event_id", r6(N.two_sided_p((F.col("bytes") - 400) / 150.0)).alias("p_value"))


@register(
    "protocol_one_hot",
    B.WITH_EV + "SELECT event_id, CASE WHEN protocol = 'mqtt' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_mqtt, "
    "CASE WHEN protocol = 'mqtt' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_coap FROM ev",
)
def protocol_one_hot(spark, sf):
    a, b = vectors.protocol_one_hot("protocol")
    return _events(spark, sf).select("event_id", a.alias("is_mqtt"), b.alias("is_coap"))


@register(
    "padded_vector",
    B.WITH_EV + "SELECT event_id, generate_subscripts(v, 1) - 1 AS position, unnest(v) AS value FROM (SELECT event_id, "
    "list_concat(list_transform(range(15), lambda i: i / 20.0::DOUBLE), CASE WHEN protocol = 'mqtt' "
    "THEN list_concat([1.0::DOUBLE, 0.0::DOUBLE], list_concat(list_transform(range(8), lambda i: k / 100.0::DOUBLE), list_transform(range(8), lambda i: 0.0::DOUBLE))) "
    "ELSE list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_concat(list_transform(range(8), lambda i: 0.0::DOUBLE), list_transform(range(8), lambda i: k / 100.0::DOUBLE))) END) AS v FROM ev)",
)
def padded_vector(spark, sf):
    shared = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: i / 20.0)
    aux = F.array_repeat(F.col("k") / 100.0, 8)
    return _events(spark, sf).select(
        "event_id", F.posexplode(vectors.pad_vector(shared, "protocol", aux)).alias("position", "value")
    ).withColumn("position", F.col("position").cast("long"))


# ---- vectors ------------------------------------------------------------------------------


@register(
    "raw_features",
    B.WITH_EV + "SELECT event_id, CAST(bytes AS DOUBLE) AS raw_bytes, CAST(length(source_id) AS DOUBLE) AS raw_source_len, "
    f"{q6(B.entropy('detail'))} AS raw_entropy FROM ev",
)
def raw_features(spark, sf):
    raw = vectors.raw_features(packet_events(spark, sf))
    return raw.select("event_id", "raw_bytes", "raw_source_len", r6("raw_entropy").alias("raw_entropy"))


def _rounded(df, *keep):
    return df.select(*keep, *[r6(f).alias(f) for f in FEATURES])


_R_ALL = ", ".join(f"{q6(f)} AS {f}" for f in FEATURES)


@register("legacy_vector", B.WITH_LEGACY + f"SELECT event_id, {_R_ALL} FROM lv")
def legacy_vector(spark, sf):
    return _rounded(vectors.legacy_vector(_events(spark, sf)), "event_id")


@register(
    "dataset_vector",
    B.WITH_EV
    + B.select_features(B.legacy_expr("lower(trim(detail))"), "event_id", "ev", True),
)
def dataset_vector(spark, sf):
    messy = _events(spark, sf).withColumns(
        {"detail": F.concat(F.lit(" "), F.upper("detail")), "event": F.upper("event"), "direction": F.upper("direction")}
    )
    return _rounded(vectors.dataset_vector(messy), "event_id")


@register(
    "dataset_rows",
    B.WITH_LEGACY
    + "SELECT run_id, scenario, label, rep, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, protocol, direction, event, "
    f"bytes, detail, {_R_ALL} FROM lv WHERE event_id % 10 <> 9",
)
def dataset_rows(spark, sf):
    ev = _events(spark, sf)
    foreign = F.when(F.col("event_id") % 10 == 9, "http").otherwise(F.concat(F.lit(" "), F.upper("protocol")))
    rows = vectors.dataset_rows(ev.withColumn("protocol", foreign))
    return _rounded(rows, *[c for c in rows.columns if c not in FEATURES])


@register(
    "dataset_manifest",
    B.WITH_EV + "SELECT m.run_id, m.scenario, m.label, m.rep, count(*) AS rows, CAST(sum(e.bytes) AS BIGINT) AS bytes FROM ev e JOIN "
    "(SELECT run_id, min(label) AS label, 'scenario-' || min(label) AS scenario, min(rep) AS rep FROM ev GROUP BY run_id) m USING (run_id) GROUP BY ALL",
)
def dataset_manifest(spark, sf):
    ev = _events(spark, sf)
    runs = ev.groupBy("run_id").agg(F.min("label").alias("label"), F.min("rep").alias("rep")).withColumn(
        "scenario", F.concat(F.lit("scenario-"), "label")
    )
    rows = vectors.dataset_rows(ev.drop("label", "scenario", "rep"), runs)
    return rows.groupBy("run_id", "scenario", "label", "rep").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")
    )


@register(
    "feature_long",
    B.WITH_LEGACY + f"SELECT event_id, feature, {q6('value')} AS value FROM (UNPIVOT (SELECT event_id, {', '.join(FEATURES)} FROM lv) "
    f"ON {', '.join(FEATURES)} INTO NAME feature VALUE value)",
)
def feature_long(spark, sf):
    wide = vectors.legacy_vector(_events(spark, sf)).select("event_id", *FEATURES)
    back = vectors.to_wide(vectors.to_array(wide))
    return vectors.to_long(back, ["event_id"]).withColumn("value", r6("value"))


@register(
    "feature_spec",
    "SELECT CAST(i AS INTEGER) AS position, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, "
    "CASE WHEN i < 15 THEN 'normalized' WHEN i < 17 THEN 'protocol_identifier' WHEN i < 25 THEN 'mqtt_auxiliary' ELSE 'coap_auxiliary' END AS feature_group, "
    "n AS non_zero FROM (" + B.WITH_LEGACY + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS i, count(*) FILTER ({f} <> 0) AS n FROM lv" for i, f in enumerate(FEATURES)
    ) + "))",
)
def feature_spec(spark, sf):
    long = vectors.to_long(vectors.legacy_vector(_events(spark, sf)).select(*FEATURES), [])
    used = long.groupBy("feature").agg(F.count_if(F.col("value") != 0).alias("non_zero"))
    return vectors.feature_spec(spark).join(used, "feature")


@register("behavioral_vector", B.WITH_BEHAVIORAL + f"SELECT event_id, {_R_ALL} FROM bv")
def behavioral_vector(spark, sf):
    return _rounded(vectors.behavioral_vector(incoming(packet_events(spark, sf))), "event_id")


@register(
    "active_vectors",
    B.WITH_BOTH + "SELECT b.event_id, true AS behavioral_enabled, "
    + q6(" + ".join(f"l.{f}" for f in FEATURES)) + " AS legacy_sum, "
    + q6(" + ".join(f"b.{f}" for f in FEATURES)) + " AS behavioral_sum, "
    + q6(" + ".join(f"b.{f}" for f in FEATURES)) + " AS active_sum FROM bv b JOIN lv l USING (event_id)",
)
def active_vectors(spark, sf):
    both = vectors.both_vectors(incoming(packet_events(spark, sf)))

    def total(name):
        return r6(F.aggregate(F.col(name), F.lit(0.0), lambda a, x: a + x)).alias(f"{name}_sum")

    return both.select("event_id", "behavioral_enabled", total("legacy"), total("behavioral"), total("active"))


# ---- per-source state ---------------------------------------------------------------------


def _state_query(name: str, needed: list[str], spark_cols, sql_cols: str):
    @register(name, B.WITH_STATE + f"SELECT event_id, {sql_cols} FROM st")
    def run(spark, sf):
        st = state.source_state(_clients(spark, sf), needed)
        return st.select("event_id", *spark_cols())

    return run


def _ratio(a: str, n: str):
    return r6(F.col(a).cast("double") / F.col(n))


_state_query("inter_arrival", ["gap_ms"], lambda: ["gap_ms"], "gap_ms")
_state_query(
    "session_duration", ["start_us"],
    lambda: ["start_us", ((F.col("t_us") - F.col("start_us")) / 1e6).alias("session_s")],
    "start_us, (t_us - start_us) / 1e6 AS session_s",
)
_state_query("msg_rate_1s", ["n1"], lambda: [F.col("n1").alias("messages")], "n1 AS messages")
_state_query("distinct_resources_10s", ["resources10"], lambda: [F.col("resources10").alias("resources")], "resources10 AS resources")
_state_query("error_rate_10s", ["err10", "n10"], lambda: [_ratio("err10", "n10").alias("error_rate")], f"{q6('CAST(err10 AS DOUBLE) / n10')} AS error_rate")
_state_query("handshake_10s", ["hs10", "n10"], lambda: [_ratio("hs10", "n10").alias("handshake_rate")], f"{q6('CAST(hs10 AS DOUBLE) / n10')} AS handshake_rate")
_state_query("reconnects_30s", ["open30"], lambda: [F.col("open30").alias("reconnects")], "open30 AS reconnects")
_state_query("breadth_30s", ["breadth30"], lambda: [F.col("breadth30").alias("breadth")], "breadth30 AS breadth")
_state_query(
    "size_std_30s", ["n30", "b30", "bb30"],
    lambda: [r6(N.pop_std("n30", "b30", "bb30")).alias("size_std")], f"{q6(B.STD30)} AS size_std",
)
_state_query(
    "coap_type_share_10s", ["con10", "non10", "ack10", "rst10"],
    lambda: ["con10", "non10", "ack10", "rst10"], "con10, non10, ack10, rst10",
)
_state_query(
    "option_mean_10s", ["opt10", "n10"],
    lambda: [r6(F.col("opt10") / 1e6 / F.col("n10")).alias("option_mean")], f"{q6('CAST(opt10 AS DOUBLE) / n10')} AS option_mean",
)


_ONE_SOURCE = B.WITH_STATE.replace("protocol || '-' || src AS source_id", "CASE WHEN protocol = 'mqtt' THEN 'mqtt-client' ELSE protocol || '-' || src END AS source_id")


@register("one_source_windows", _ONE_SOURCE + "SELECT event_id, gap_ms, start_us, n1, resources10, err10, open30, n30, b30, bb30 FROM st")
def one_source_windows(spark, sf):
    """All MQTT clients under the one name they have by default, so that one source is half of the traffic: windows by slot."""
    clients = _clients(spark, sf)
    named = clients.withColumn("source_id", F.when(F.col("protocol") == "mqtt", "mqtt-client").otherwise(F.col("source_id")))
    picked = ["gap_ms", "start_us", "n1", "resources10", "err10", "open30", "n30", "b30", "bb30"]
    return state.source_state(named, picked, slots=Slots()).select("event_id", *picked)


@register(
    "state_keys",
    B.WITH_EV + "SELECT protocol || ':' || source_id AS state_key, count(*) AS packets, min(t_us) AS first_us, max(t_us) AS last_us "
    "FROM ev WHERE direction = 'incoming' GROUP BY ALL",
)
def state_keys(spark, sf):
    return (
        _clients(spark, sf)
        .groupBy(state.state_key().alias("state_key"))
        .agg(F.count(F.lit(1)).alias("packets"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    )


# ---- detection ----------------------------------------------------------------------------


@register("rules", B.WITH_SCORED + "SELECT event_id, rule_reason <> '' AS rule_triggered, rule_reason FROM sc")
def rules(spark, sf):
    s = _scored(spark, sf)
    return s.select("event_id", (F.col("rule_reason") != "").alias("rule_triggered"), "rule_reason")


@register("heuristic_score", B.WITH_SCORED + f"SELECT event_id, {q6('anomaly_score')} AS anomaly_score, predicted_label FROM sc")
def heuristic_score(spark, sf):
    return _scored(spark, sf).select("event_id", r6("anomaly_score").alias("anomaly_score"), "predicted_label")


@register(
    "model_or_heuristic",
    B.WITH_SCORED
    + f"SELECT event_id, {q6('coalesce(CASE WHEN k % 3 = 0 THEN k / 100.0::DOUBLE END, anomaly_score)')} AS anomaly_score FROM sc",
)
def model_or_heuristic(spark, sf):
    k = F.col("k")
    vec = vectors.behavioral_vector(_clients(spark, sf), detect.NEEDED_FEATURES)
    scored = vec.withColumn("model", F.when(k % 3 == 0, k / 100.0).when(k % 3 == 1, F.lit(-1.0)))
    out = detect.evaluate(scored, model_score="model")
    return out.select("event_id", r6("anomaly_score").alias("anomaly_score"))


@register("decisions", B.WITH_SCORED + "SELECT event_id, allow, action, reason FROM sc")
def decisions(spark, sf):
    return _scored(spark, sf).select("event_id", "allow", "action", "reason")


@register(
    "stateless_decisions",
    B.WITH_EV + "SELECT event_id, CASE WHEN event = 'traffic' THEN 'drop' WHEN s >= 0.97 THEN 'drop' ELSE 'forward' END AS action FROM ("
    f"SELECT *, {B.clamp01('ln(1 + greatest(CAST(bytes AS DOUBLE), 0.0)) / ln(4097.0::DOUBLE)')} AS s FROM ev WHERE direction = 'incoming')",
)
def stateless_decisions(spark, sf):
    vec = vectors.active_vector(_clients(spark, sf), behavioral_enabled=False, features=detect.NEEDED_FEATURES)
    return detect.evaluate(vec).select("event_id", "action")


@register(
    "route_log",
    B.WITH_SCORED
    + "SELECT event_id, t_us, protocol, source_id, CASE WHEN allow THEN direction ELSE 'mitigation' END AS direction, "
    "CASE WHEN allow THEN event ELSE action END AS event, bytes, CASE WHEN allow THEN detail ELSE reason END AS detail FROM sc",
)
def route_log(spark, sf):
    return detect.route(_scored(spark, sf))


@register(
    "source_actions",
    B.WITH_SCORED + "SELECT protocol, source_id, action, reason, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, "
    f"{q6('max(anomaly_score)')} AS top_score FROM sc GROUP BY ALL",
)
def source_actions(spark, sf):
    return (
        _scored(spark, sf)
        .groupBy("protocol", "source_id", "action", "reason")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"), r6(F.max("anomaly_score")).alias("top_score"))
    )


@register(
    "settings_effect",
    B.WITH_SCORED + "SELECT 0.95::DOUBLE AS rule_msg_rate, 0.97::DOUBLE AS rule_payload, 0.6::DOUBLE AS infer_rate_limit, 0.9::DOUBLE AS infer_drop, "
    "CASE WHEN rule_reason <> '' OR anomaly_score >= 0.9 THEN 'drop' WHEN anomaly_score >= 0.6 THEN 'rate_limit' ELSE 'forward' END AS action, "
    "count(*) AS packets FROM sc GROUP BY ALL",
)
def settings_effect(spark, sf):
    settings = Detection.from_texts(rate_limit="0.6", drop="1.7")
    vec = vectors.behavioral_vector(_clients(spark, sf), detect.NEEDED_FEATURES)
    counts = detect.evaluate(vec, settings).groupBy("action").agg(F.count(F.lit(1)).alias("packets"))
    return counts.select("*", *[c.alias(n) for n, c in detect.settings_columns(settings).items()])
