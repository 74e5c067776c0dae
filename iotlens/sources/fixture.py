"""Packet events derived from the given ``events`` table.

The given tables hold no packets, so every registered query starts from this
projection: one packet event per row of ``events``, computed by plain column
expressions (no shuffle).  ``iotlens.plans.oracle`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from iotlens.functions.numeric import settled
from iotlens.session import prepare

# Start of the event table in UTC micros and the per-source time compression.
START_US = 1_704_067_200_000_000


def raw_events(ev: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return ev.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        F.expr("user_id div 10").alias("src"),
    ).withColumn("protocol", F.when(F.col("src") % 2 == 0, "mqtt").otherwise("coap"))


def _lit_if(cond: Column, text) -> Column:
    return F.when(cond, text if isinstance(text, Column) else F.lit(text)).otherwise(F.lit(""))


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _topic() -> Column:
    return F.concat(F.lit("site/"), (F.col("k") % 4).cast("string"), F.lit("/dev/"), (F.col("k") % 9).cast("string"))


def _mqtt_detail() -> Column:
    kind, k = F.col("event_type"), F.col("k")
    route = F.when(F.col("direction") == "outgoing", "broker_to_client").otherwise("client_to_broker")
    qos = F.concat(F.lit("|qos:"), (k % 3).cast("string"))
    body = (
        F.when(
            kind == "signup",
            F.concat(
                F.lit("|connect|client_id:dev-"), _s("user_id"), _lit_if(k % 5 == 0, "|will"),
                F.lit("|keepalive:"), (k * 5).cast("string"),
            ),
        )
        .when((kind == "purchase") & (k % 8 == 0), F.lit("|subscribe|wildcard"))
        .when(kind == "error", F.concat(F.lit("|publish|malform"), qos, F.lit("|topic:"), _topic()))
        .when((kind == "click") & (k % 20 == 0), F.lit("|pubrel"))
        .otherwise(
            F.concat(F.lit("|publish"), qos, _lit_if(k % 10 == 0, "|retain"), F.lit("|topic:"), _topic())
        )
    )
    return F.concat(route, body)


def _coap_detail() -> Column:
    kind, k = F.col("event_type"), F.col("k")
    route = F.when(F.col("direction") == "outgoing", "backend_to_client").otherwise("client_to_backend")
    typ = F.element_at(F.array(*[F.lit(x) for x in ("con", "non", "ack", "rst")]), k % 4 + 1)
    method = (
        F.when(kind == "view", "get").when(kind == "click", "post").when(kind == "purchase", "put").otherwise("delete")
    )
    body = F.when(kind == "error", F.lit("|con|get|malform")).otherwise(
        F.concat(
            F.lit("|"), typ, F.lit("|"), method, F.lit("|token:"), _s("k"),
            F.lit("|path:/s/"), (k % 4).cast("string"), F.lit("/r/"), (k % 7).cast("string"),
            _lit_if(k % 6 == 0, "|observe"), _lit_if(k % 11 == 0, "|blockwise"),
            F.lit("|optcount:"), (k % 5 + 2).cast("string"),
        )
    )
    return F.concat(route, body)


def packet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical packet events with run and label columns."""
    prepare(spark)
    return as_packet_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


# Bytes of files that a stream reads in one trigger.
TRIGGER_BYTES = 256 * 1024 * 1024


def disorder_us(rows: DataFrame, keys: list[str], trigger_bytes: int = TRIGGER_BYTES) -> int:
    """Delay by which rows must wait so that a stream over the files of ``rows`` applies each key's rows in time order.

    A stream reads files by their time of change.  Per key, a file's first row lies at most so far behind, or at,
    the last row of the files that may be read before it.  0 if one trigger reads all, or no row lies behind.
    """
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct()  # one row per file
    if files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0] <= trigger_bytes or files.count() == 1:
        return 0
    rows = rows.select(*keys, "t_us", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    spans = rows.groupBy(*keys, "file", "changed").agg(F.min("t_us").alias("first"), F.max("t_us").alias("last"))
    # At most one row per key and file; files of equal time may come in any order.
    earlier = Window.partitionBy(*keys).orderBy("changed").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.filter(F.collect_list(F.struct("file", "last")).over(earlier), lambda x: x["file"] != F.col("file"))
    gap = spans.select((F.array_max(F.transform(ahead, lambda x: x["last"])) - F.col("first")).alias("gap")).agg(F.max("gap")).first()[0]
    return gap + 1 if gap is not None and gap >= 0 else 0


def packet_event_stream(spark: SparkSession, sf_dir: str, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """The same rows as a file-backed stream, whether the table is one file or a folder of part files."""
    prepare(spark)
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    files = table.inputFiles()
    reader = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", trigger_bytes)
    if len(files) == 1 and files[0].endswith("/events.parquet"):  # a stream reads folders: that of the file, and of it this file
        return as_packet_events(reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    return as_packet_events(reader.parquet(path))


def as_packet_events(table: DataFrame) -> DataFrame:
    mqtt = F.col("protocol") == "mqtt"
    kind, src = F.col("event_type"), F.col("src")
    df = raw_events(table).withColumns(
        {
            "t_us": F.expr(f"{START_US}L + (us - {START_US}L) div (3600 * (1 + 6 * (src % 5)))"),
            "source_id": F.concat("protocol", F.lit("-"), _s("src")),
            "direction": F.when(F.col("event_id") % 6 == 5, "outgoing").otherwise("incoming"),
            "event": F.when(mqtt & (kind == "signup"), "connection_open").otherwise("traffic"),
            "bytes": F.least(F.floor(F.col("value") * 12), F.when(mqtt, 4096).otherwise(2048).cast("long")),
            "mid": (F.col("event_id") % 64).cast("int"),
            "rep": (F.col("event_id") % 3).cast("int"),
        }
    )
    label = (
        F.when(kind == "error", F.concat("protocol", F.lit("_protocol_abuse")))
        .when(mqtt & (kind == "purchase") & (F.col("k") % 8 == 0), "mqtt_wildcard_abuse")
        .when(src % 5 == 4, F.when(mqtt, "mqtt_publish_flood").otherwise("coap_request_flood"))
        .otherwise("benign")
    )
    return df.select(
        "event_id", "t_us", "protocol", "source_id", "direction", "event", "bytes",
        F.when(mqtt, _mqtt_detail()).otherwise(_coap_detail()).alias("detail"),
        "mid",
        F.concat("protocol", F.lit("-R"), (src % 7).cast("string"), F.lit("-"), _s("rep")).alias("run_id"),
        "rep",
        label.alias("label"),
        label.alias("scenario"),
        "user_id", "k", "src", "event_type",
    ).withColumn("payload", F.col("detail").cast("binary"))


def incoming(events: DataFrame) -> DataFrame:
    """Client packets: the only rows that reach the feature step."""
    return events.filter(F.col("direction") == "incoming")


# ---- packets -------------------------------------------------------------------------------


def _hex_byte(n) -> Column:
    return F.lpad(F.hex(n.cast("long") if isinstance(n, Column) else F.lit(n)), 2, "0")


def _hex_u16(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 4, "0")


def _hex_text(text: Column) -> Column:
    return F.hex(text.cast("binary"))


def _hex_prefixed(text: Column) -> Column:
    return F.concat(_hex_u16(F.octet_length(text)), _hex_text(text))


def _hex_mqtt(first: Column, body_hex: Column, extra: Column) -> Column:
    """Fixed header with a one or two byte length field, then the body."""
    n = F.octet_length(body_hex) / 2 + extra
    n = n.cast("int")
    length = F.when(n < 128, _hex_byte(n)).otherwise(F.concat(_hex_byte(n % 128 + 128), _hex_byte(F.floor(n / 128))))
    return F.concat(_hex_byte(first), length, body_hex)


def _mqtt_hex() -> Column:
    kind, k = F.col("event_type"), F.col("k")
    pid = F.lit("000A")
    connect = F.concat(
        F.lit("00044D51545404"), F.when(k % 5 == 0, "06").otherwise("02"), _hex_u16(k * 5),
        _hex_prefixed(F.concat(F.lit("dev-"), _s("user_id"))),
    )
    filters = F.concat(pid, _hex_prefixed(F.lit("plain/topic")), F.lit("01"), _hex_prefixed(F.lit("site/+/dev")), F.lit("00"))
    filler = F.repeat(F.lit("61"), F.col("bytes").cast("int"))
    publish = F.concat(_hex_prefixed(_topic()), F.when(k % 3 > 0, pid).otherwise(""), filler)
    retain = F.when((kind != "error") & (k % 10 == 0), 1).otherwise(0)
    fault = F.when(kind == "error", 9).otherwise(0)
    return (
        F.when(kind == "signup", _hex_mqtt(F.lit(0x10), connect, F.lit(0)))
        .when((kind == "purchase") & (k % 8 == 0), _hex_mqtt(F.lit(0x82), filters, F.lit(0)))
        .when((kind == "click") & (k % 20 == 0), F.lit("6202000A"))
        .otherwise(_hex_mqtt(F.lit(0x30) + (k % 3) * 2 + retain, publish, fault))
    )


def _coap_hex() -> Column:
    kind, k = F.col("event_type"), F.col("k")
    method = F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).otherwise(4)
    observe, block = k % 6 == 0, k % 11 == 0
    last = F.when(block, 23).when(k % 5 == 2, 15).otherwise(11)
    options = F.concat(
        F.when(observe, "60").otherwise(""),
        F.when(observe, "5173").otherwise("B173"),
        F.lit("01"), _hex_text((k % 4).cast("string")),
        F.lit("0172"), F.lit("01"), _hex_text((k % 7).cast("string")),
        F.when(k % 5 == 2, F.concat(F.lit("4D07"), F.repeat(F.lit("71"), 20))).otherwise(""),
        F.when(block, F.concat(_hex_byte((F.lit(23) - F.when(k % 5 == 2, 15).otherwise(11)) * 16 + 1), F.lit("06"))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit("D1"), _hex_byte(F.lit(60) - last - 13), F.lit("40")))
        .when(k % 5 == 1, F.concat(F.lit("E0"), _hex_u16(F.lit(2049) - last - 269)))
        .otherwise(""),
    )
    payload = F.concat(F.lit("FF"), F.repeat(F.lit("62"), F.col("bytes").cast("int")))
    token = F.lpad(_s("k"), 2, "0")
    body = F.concat(_hex_byte(F.lit(0x41) + (k % 4) * 16), _hex_byte(method), _hex_u16(F.col("mid")), token, options, payload)
    return F.when(kind == "error", F.concat(F.lit("8001"), _hex_u16(F.col("mid")))).otherwise(body)


def capture(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Binary packets whose decoded text is known from the event they were made from."""
    ev = packet_events(spark, sf_dir).drop("payload")
    packet = F.when(F.col("protocol") == "mqtt", _mqtt_hex()).otherwise(_coap_hex())
    return settled(ev, {"payload": F.unhex(packet)}).select(
        "event_id", "t_us", "protocol", F.col("source_id").alias("endpoint"), "direction", "payload", *extra
    )
