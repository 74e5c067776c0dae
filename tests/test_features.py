"""Sliding state, feature boundaries, quirks and invariants."""

import pytest
from pyspark.sql import functions as F

from iotlens.functions import detail as D
from iotlens.functions import entropy as E
from iotlens.operators import detect, ranks, sliding, state, vectors
from iotlens.schemas import FEATURES
from iotlens.settings import SECOND_US, Buckets, Detection, Slots, unit_setting
from iotlens.sources.fixture import incoming, packet_events

EVENT = "event_id long, t_us long, protocol string, source_id string, direction string, event string, bytes long, detail string"


def events(spark, rows):
    """Rows of (t_us, bytes, detail, event) for one MQTT source, or with protocol and source."""
    out = []
    for i, r in enumerate(rows):
        t, size, detail, event, protocol, source = (*r, *("traffic", "mqtt", "s")[len(r) - 3 :])
        out.append((i, t, protocol, source, "incoming", event, size, detail))
    return spark.createDataFrame(out, EVENT)


def column(df, name):
    return [r[name] for r in df.orderBy("event_id").collect()]


@pytest.mark.parametrize("width_s", [30, 45, 120, 100_000])
def test_sliding_equals_plain_frames(spark, medium, width_s):
    ev = incoming(packet_events(spark, medium)).drop("payload").select("event_id", *state.KEYS, "t_us", "bytes")
    widths = {SECOND_US: {"a": F.lit(1)}, 30 * SECOND_US: {"b": F.col("bytes"), "c": F.lit(1)}}
    fast = sliding.sliding_sums(ev, state.KEYS, "t_us", widths, buckets=Buckets(width_s * SECOND_US))
    plain = sliding.plain_sliding_sums(ev, state.KEYS, "t_us", widths)
    assert fast.count() == plain.count()
    assert fast.exceptAll(plain.select(fast.columns)).isEmpty()


@pytest.mark.parametrize("width_s", [30, 3600])
def test_state_does_not_depend_on_buckets(spark, medium, width_s):
    ev = incoming(packet_events(spark, medium)).drop("payload")
    pick = ["event_id", *state.ALL]
    a = state.source_state(ev, buckets=Buckets(width_s * SECOND_US)).select(pick)
    b = state.source_state(ev).select(pick)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_equal_times_see_each_other(spark):
    t = 1_000_000_000
    df = events(spark, [(t, 1, "x|topic:a"), (t, 1, "x|topic:b"), (t + 10, 1, "x|topic:a")])
    st = state.source_state(df)
    assert column(st, "n1") == [2, 2, 3]
    assert column(st, "resources10") == [2, 2, 2]
    assert column(st, "gap_ms") == [1000, 0, 0]


def test_window_edges(spark):
    t = 60 * SECOND_US
    df = events(spark, [(t, 1, "x"), (t + SECOND_US, 1, "x"), (t + 2 * SECOND_US + 1, 1, "x")])
    assert column(state.source_state(df, ["n1"]), "n1") == [1, 2, 1]


@pytest.mark.parametrize("n,action", [(18, "forward"), (19, "drop")])
def test_rate_rule_edge(spark, n, action):
    rows = [(120 * SECOND_US + i, 10, "client_to_broker|publish") for i in range(n)]
    out = detect.evaluate(vectors.behavioral_vector(events(spark, [(r[0] * 1, *r[1:]) for r in rows]), ["f00", "f02"]))
    last = out.orderBy(F.desc("t_us")).first()
    assert last["action"] == action
    assert last["reason"] == ("rule:msg_rate_exceeded" if n == 19 else "")


@pytest.mark.parametrize("size,reason", [(3191, ""), (3192, "rule:oversized_payload")])
def test_size_rule_edge(spark, size, reason):
    out = detect.evaluate(vectors.behavioral_vector(events(spark, [(SECOND_US, size, "p")]), ["f00", "f02"]))
    assert out.first()["reason"] == reason


def test_rate_limit_is_allowed(spark):
    rows = [(120 * SECOND_US + i, 3100, "client_to_broker|publish") for i in range(13)]
    last = detect.evaluate(vectors.behavioral_vector(events(spark, rows), ["f00", "f02"])).orderBy(F.desc("event_id")).first()
    assert (last["action"], last["allow"], last["reason"]) == ("rate_limit", True, "inference:elevated_anomaly_score")
    assert last["anomaly_score"] == pytest.approx(0.762, abs=2e-3)


def test_first_event_and_reconnect(spark):
    df = events(spark, [
        (SECOND_US, 1, "client_to_broker|publish"),
        (50 * SECOND_US, 1, "client_to_broker|publish"),
        (101 * SECOND_US, 1, "client_to_broker|connect|keepalive:0", "connection_open"),
        (131 * SECOND_US, 1, "client_to_broker|publish"),
        (132 * SECOND_US, 1, "client_to_broker|publish"),
    ])
    v = vectors.behavioral_vector(df)
    assert column(v, "f01")[0] == 0.0
    assert column(v, "f00")[0] == 0.05
    assert column(v, "f07") == pytest.approx([0, 49 / 300, 0, 30 / 300, 31 / 300])
    assert column(v, "f12") == pytest.approx([0, 0, 1 / 30, 1 / 30, 0])
    assert column(v, "f20")[2] == 0.0 and column(v, "f20")[0] == pytest.approx(0.2)
    assert column(v, "f24")[0] == 0.0


def test_substring_quirks(spark):
    df = events(spark, [
        (1, 1, "client_to_backend|non|get|path:/icon", "traffic", "coap", "a"),
        (2, 1, "client_to_broker|connect|client_id:x", "traffic", "mqtt", "b"),
        (3, 1, "client_to_broker|puback|x", "traffic", "mqtt", "b"),
        (4, 1, "client_to_broker|publish|qos:0|topic:t/will/retain", "traffic", "mqtt", "b"),
    ])
    legacy = vectors.legacy_vector(df)
    assert column(legacy, "f06")[0] == 1.0
    flags = df.select("event_id", D.type_mark("detail", "con").alias("con"), D.type_mark("detail", "ack").alias("ack"))
    assert column(flags, "con")[1] is True and column(flags, "ack")[2] is True
    v = vectors.behavioral_vector(df)
    assert column(v, "f21")[3] == 1.0 and column(v, "f17")[3] == 1.0
    assert column(v, "f04")[0] == pytest.approx(2 / 8)


def test_stateless_mode_drops_traffic(spark, small):
    ev = incoming(packet_events(spark, small)).filter(F.col("event") == "traffic")
    out = detect.evaluate(vectors.active_vector(ev, behavioral_enabled=False, features=["f00", "f02"]))
    assert out.filter("action <> 'drop' or reason <> 'rule:msg_rate_exceeded'").isEmpty()


def test_invariants(spark, small):
    v = vectors.behavioral_vector(incoming(packet_events(spark, small)))
    bad = F.lit(False)
    for f in FEATURES:
        bad = bad | ~F.col(f).between(0.0, 1.0)
    assert v.filter(bad).isEmpty()
    assert v.filter((F.col("f15") + F.col("f16")) != 1.0).isEmpty()
    assert v.filter(F.abs(F.col("f14") - (1 - F.col("f09"))) > 1e-12).isEmpty()
    mqtt_only, coap_only = FEATURES[17:25], FEATURES[25:33]
    for f in mqtt_only:
        assert v.filter((F.col("protocol") == "coap") & (F.col(f) != 0)).isEmpty()
    for f in coap_only:
        assert v.filter((F.col("protocol") == "mqtt") & (F.col(f) != 0)).isEmpty()


def test_one_exchange_of_rows(spark, small):
    """Rows are shuffled once for all windows."""
    st = state.source_state(incoming(packet_events(spark, small)).drop("payload"), ["n1", "resources10", "b30"])
    plan = st._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_entropy_forms(spark):
    import pyarrow as pa

    got = E.batch_entropy(pa.array([b"", b"aaaa", b"ab", bytes(range(256)), None], pa.binary()))
    assert list(got) == pytest.approx([0, 0, 1, 8, 0])
    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("é",), (None,)], "s string")
    out = [r[0] for r in df.select(E.text_entropy("s")).collect()]
    assert out == pytest.approx([0, 0, 1, 1, 0])


def test_unknown_protocol_stops(spark):
    df = spark.createDataFrame([("http",)], "protocol string")
    with pytest.raises(Exception, match="unsupported protocol"):
        df.select(*vectors.protocol_one_hot("protocol")).collect()


def test_settings():
    assert unit_setting("0.5", 0.9) == 0.5
    for bad in (None, "", " 0.5", "0.5x", "nan", "inf", "1.5", "-0.1"):
        assert unit_setting(bad, 0.9) == 0.9
    with pytest.raises(ValueError):
        Detection(drop=2.0)
    with pytest.raises(ValueError):
        Buckets(1)


def test_hot_source_is_split(spark):
    """One source with all rows still spreads over buckets and stays exact."""
    df = spark.range(20_000).select(
        F.col("id").alias("event_id"), (F.col("id") * 37_000).alias("t_us"), F.lit("mqtt").alias("protocol"),
        F.lit("mqtt-client").alias("source_id"), F.lit("incoming").alias("direction"), F.lit("traffic").alias("event"),
        (F.col("id") % 900).alias("bytes"), F.lit("client_to_broker|publish|topic:a").alias("detail"),
    )
    st = state.source_state(df, ["n1", "n30", "b30", "gap_ms", "start_us"])
    assert st.filter((F.col("event_id") > 900) & (F.col("n1") != 28)).isEmpty()
    assert st.filter((F.col("event_id") > 900) & (F.col("n30") != 811)).isEmpty()
    assert st.filter((F.col("event_id") > 0) & ((F.col("gap_ms") != 37) | (F.col("start_us") != 0))).isEmpty()


def flood(spark, rows, gap_us):
    """One source with all rows, and three others with a few."""
    return spark.range(rows).select(
        F.col("id").alias("event_id"), (F.col("id") * gap_us).alias("t_us"), F.lit("coap").alias("protocol"),
        F.when(F.col("id") % 100 < 97, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source_id"), F.lit("incoming").alias("direction"),
        F.when(F.col("id") % 5000 == 1, "connection_open").otherwise("traffic").alias("event"), (F.col("id") % 900).alias("bytes"),
        F.concat(F.lit("con|get|path:/r"), (F.pow(F.col("id") % 1013, 2) % 7).cast("int").cast("string")).alias("detail"),
    )


def test_hot_source_has_no_large_task(spark):
    """A flood of one source within 100 s is dealt out by slot, whatever the source."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = 100_000
        out = state.source_state(flood(spark, rows, 1000), slots=Slots())
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sum(sizes) == rows and len(sizes) == 8 and max(sizes) < 0.3 * rows


def test_flood_equals_plain_frames(spark):
    ev = flood(spark, 4000, 9_000)
    got = state.source_state(ev, slots=Slots(30 * SECOND_US, SECOND_US // 4)).drop("gap_ms", "start_us", "resources10")
    widths = {w: {n: state._values()[n] for n in names if n != "resources10"} for w, names in state._WINDOWED.items()}
    want = sliding.plain_sliding_sums(ev, state.KEYS, "t_us", widths).select(got.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == 4000


def test_facts_and_distinct_values_row_by_row(spark):
    """Previous row, session start and distinct resources of every row against a walk in plain Python."""
    import random

    rnd = random.Random(5)
    t, rows = 0, []
    for k in range(1500):
        t += rnd.choice([0, 0, 1, 1000, 400_000, 3 * SECOND_US, 11 * SECOND_US, 200 * SECOND_US]) if rnd.random() < 0.7 else 20_000
        rows.append((k, t, rnd.choice("ab"), rnd.choice(["connection_open"] + ["traffic"] * 9), f"x|topic:{rnd.choice('pqrs')}"))
    df = spark.createDataFrame([(k, t, "mqtt", s, "incoming", e, 1, d) for k, t, s, e, d in rows], EVENT)
    got = {r["event_id"]: r for r in state.source_state(df, ["gap_ms", "start_us", "resources10"], slots=Slots(60 * SECOND_US, SECOND_US)).collect()}
    last, start = {}, {}
    for k, t, s, e, _ in rows:
        start[s] = t if e == "connection_open" else start.get(s, t)
        seen = {d for _, u, z, _, d in rows if z == s and t - 10 * SECOND_US <= u <= t}
        r = got[k]
        assert (r["gap_ms"], r["start_us"], r["resources10"]) == ((t - last[s]) // 1000 if s in last else 1000, start[s], len(seen)), k
        last[s] = t


@pytest.mark.parametrize("slots", [Slots(), Slots(120 * SECOND_US, 10 * SECOND_US)])
def test_slots_give_the_rows_of_buckets(spark, medium, slots):
    ev = incoming(packet_events(spark, medium)).drop("payload")
    pick = ["event_id", *state.ALL]
    a = state.source_state(ev, slots=slots).select(pick)
    b = state.source_state(ev).select(pick)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with pytest.raises(ValueError):
        Slots(slot_us=0)


def test_order_statistics_against_sorting(spark):
    rows = [("a", float(v % 17) / 3) for v in range(500)] + [("b", float(v)) for v in range(7)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = ranks.order_statistics(df, ["g"], "v", {
        "q": ranks.linear(0.37, "v"), "c": ranks.at_rank(ranks.ceil_rank(0.95), "v"), "f": ranks.at_rank(ranks.floor_rank(0.95), "v"),
        "p": ranks.at_rank(ranks.quarter_rank(3), "v"), "s": ranks.at_rank(ranks.shifted_rank(0.95), "v"), "sd": ranks.spread("v", sample=True),
    })
    import math
    import statistics

    import numpy as np

    for r in out.collect():
        s = sorted(v for g, v in rows if g == r["g"])
        n = len(s)
        assert r["q"] == pytest.approx(float(np.quantile(s, 0.37)))
        assert r["c"] == s[max(0, math.ceil(n * 0.95) - 1)]
        assert r["f"] == s[int(0.95 * n)]
        assert r["p"] == s[3 * n // 4]
        assert r["s"] == (s[int(0.95 * n - 1)] if n > 1 else s[0])
        assert r["sd"] == pytest.approx(statistics.stdev(s) if n > 1 else 0.0)
