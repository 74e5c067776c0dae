"""Session helpers.

Cluster settings come from the submitter.  Only the session zone and the size limit of
generated methods are pinned (see :func:`prepare`).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "iotlens") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .getOrCreate()
    )


# HotSpot does not compile methods beyond 8000 bytecodes.  Past that size a fused stage runs
# interpreted, so Spark is told to fall back to its split, compilable projections there.
JIT_METHOD_LIMIT = "8000"
_LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"


def prepare(spark: SparkSession) -> SparkSession:
    """Session values the operators count on.

    Times are UTC micros, so times without a zone must be read as UTC: the session zone becomes
    UTC whatever it was.  A method limit that the user chose is kept.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(_LIMIT_KEY, "65535") == "65535":
        spark.conf.set(_LIMIT_KEY, JIT_METHOD_LIMIT)
    return spark


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) one temporary folder is made per
    application; it goes when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        made = _OWN_DIRS[app] = tempfile.mkdtemp(prefix="iotlens-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _OWN_DIRS[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, for plans that read them several times."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
