"""Event logs, feature logs, datasets, snapshots and result reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotlens.functions import text as X
from iotlens.functions.numeric import settled
from iotlens.schemas import DATASET, EVENT_LOG, FEATURE_LOG, FEATURE_RECORD, FEATURES, SNAPSHOT

BAD = "_bad"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0


# ---- JSON lines ----------------------------------------------------------------------------


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Columns of the schema plus ``_bad`` (the text of a line that is not a JSON object, else null).

    Blank lines are dropped.  Nothing is lost silently: :func:`good` and :func:`bad` split
    the result.
    """
    full = T.StructType(schema.fields + [T.StructField(BAD, T.StringType())])
    read = F.from_json(F.col(column), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    # Parsed once: the good/bad filters must not repeat the parse below themselves.
    parsed = settled(lines.filter(F.trim(F.col(column)) != ""), {"_j": read})
    return parsed.select(*[c for c in lines.columns if c != column], "_j.*")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(BAD).isNull()).drop(BAD)


def bad(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder; a missing path gives no lines."""
    return spark.read.text(path) if _exists(spark, path) else spark.createDataFrame([], "value string")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(_lines(spark, path), EVENT_LOG)


def read_feature_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(_lines(spark, path), FEATURE_LOG)


def event_log_rows(events: DataFrame) -> DataFrame:
    """Canonical events in log form (time in whole seconds)."""
    return events.select(X.utc_stamp("t_us").alias("ts"), "protocol", "direction", "event", "bytes", "detail")


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_event_log(events: DataFrame, path: str, mode: str = "append") -> None:
    json_lines(event_log_rows(events)).write.mode(mode).text(path)


def feature_log_rows(decided: DataFrame) -> DataFrame:
    """Rows with both vectors and a decision, in feature-log form."""
    return decided.select(
        X.utc_stamp("t_us").alias("ts"), "protocol", "source_id", "direction", F.col("event").alias("event_type"),
        "detail", F.col("bytes").cast("double").alias("raw_bytes"), "behavioral_enabled", "legacy", "behavioral",
        "active", F.struct("allow", "action", "reason", "anomaly_score").alias("decision"),
    )


def write_feature_log(decided: DataFrame, path: str, mode: str = "append") -> None:
    json_lines(feature_log_rows(decided)).write.mode(mode).text(path)


def log_scores(feature_log: DataFrame) -> DataFrame:
    """Protocol and score of each logged vector; a missing decision gives a null score."""
    return feature_log.select(
        F.coalesce("protocol", F.lit("unknown")).alias("protocol"), F.col("decision.anomaly_score").alias("score")
    )


# ---- datasets ------------------------------------------------------------------------------

REQUIRED = ["run_id", "label", "protocol", *FEATURES]


def missing_columns(df: DataFrame, required=REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Labeled dataset; stops with the list of missing columns."""
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
        types = {f.name: f.dataType for f in DATASET.fields}
        df = df.select(*[F.col(c).cast(types.get(c, T.StringType())).alias(c) for c in df.columns])
    else:
        df = spark.read.format(fmt).load(path)
    gone = missing_columns(df)
    if gone:
        raise ValueError(f"dataset lacks columns: {gone}")
    return df


def write_dataset(rows: DataFrame, path: str, *, append: bool = True, fmt: str = "parquet") -> None:
    """Parquet is partitioned by run, so runs are added, replaced and read one by one.

    Rows are first clustered by run and then rebalanced by measured size: a run with a third of
    all rows is written by many tasks, and small runs do not leave one file per task.
    """
    mode = "append" if append else "overwrite"
    if fmt == "csv":
        rows.write.mode(mode).option("header", True).csv(path)
        return
    rows.hint("rebalance", F.col("run_id")).write.mode(mode).partitionBy("run_id").format(fmt).save(path)


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def append_feature_records(records: DataFrame, path: str) -> None:
    records.select(*[f.name for f in FEATURE_RECORD.fields]).write.mode("append").option("header", True).csv(path)


# ---- snapshots, tails, reports ----------------------------------------------------------------


def with_snapshot_defaults(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f.name), F.lit(0)).cast("long").alias(f.name) for f in SNAPSHOT.fields])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row, of the newest whole version if there are versions; a missing file or key counts as 0."""
    if versions := _versions(spark, path):
        path = f"{path}/version={versions[-1]}"
    if not _exists(spark, path):
        return with_snapshot_defaults(spark.createDataFrame([(None,) * 4], SNAPSHOT))
    return with_snapshot_defaults(spark.read.schema(SNAPSHOT).json(path, multiLine=True))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a snapshot folder that have been written to their end, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS")))


def write_version(counters: DataFrame, path: str, version: int) -> None:
    """The one-row snapshot as a new version; older ones go when it is whole.  A repeated version replaces itself."""
    spark = counters.sparkSession
    counters.coalesce(1).write.mode("overwrite").json(f"{path}/version={version}")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in _versions(spark, path):
        if old < version:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)


def write_snapshot(counters: DataFrame, path: str) -> None:
    counters.coalesce(1).write.mode("overwrite").json(path)


def event_tail(events: DataFrame, limit: int = 100) -> DataFrame:
    """The last rows in arrival order (a bounded top-k, no full sort)."""
    return events.orderBy(F.desc("t_us"), F.desc("event_id")).limit(limit)


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """One JSON folder per section of a result report."""
    for name, frame in sections.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def read_capture(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Binary packet table; columns as in ``schemas.CAPTURE``."""
    return spark.read.format(fmt).load(path)


def kafka_capture(records: DataFrame, protocol: str) -> DataFrame:
    """Capture rows from a topic-shaped table (``key``, ``value``, ``timestamp``, ``partition``, ``offset``)."""
    order: Column = F.col("partition").cast("long") * F.lit(1 << 48) + F.col("offset")
    return records.select(
        order.alias("event_id"), F.unix_micros("timestamp").alias("t_us"), F.lit(protocol).alias("protocol"),
        F.col("key").cast("string").alias("endpoint"), F.lit("incoming").alias("direction"), F.col("value").alias("payload"),
    )
