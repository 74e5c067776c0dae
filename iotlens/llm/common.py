"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import chain, count
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iotlens.session import shared_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the session."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd", group_bytes: int | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here.

    ``group_bytes`` bounds the bytes of a row group, so that few large rows are still read by many tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", codec)
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, rows: int = 200_000) -> DataFrame:
    """The rows stored, and marked for broadcast only if there are at most ``rows`` of them."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= rows else df


def unused(df: DataFrame, start: str) -> str:
    """A beginning for helper columns that no column of ``df`` has, whatever its letters' case."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(start.lower()) for c in names):
        start += "_"
    return start


def id_share(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def sample_by_count(df: DataFrame, by: str, rows: int, key: Column) -> DataFrame:
    """About ``rows`` rows of each value of ``by``: a fixed share by the hash ``key``, the same on every run."""
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    shares = [v for k, n in sizes.items() for v in (F.lit(k), F.lit(min(1.0, rows / n)))]
    if not shares:
        return df
    share = F.create_map(*shares)[F.col(by)]
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * float(1 << 30))


def factorize(lists: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word lists of a batch as codes, the distinct words in order of code, and the list lengths."""
    codes: dict[str, int] = defaultdict(count().__next__)
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int64, int(lens.sum()))
    return flat, list(codes), lens


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (``WORD_PATTERN``) of all texts in order, and the number of words of each.

    On UTF-8 bytes, ``split`` cuts at exactly these six characters and ``lower`` changes A-Z only.
    """
    raw = (t.encode("utf-8", "surrogatepass") if t else b"" for t in texts)
    lists = [(r.lower() if lower else r).split() for r in raw]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lists)), np.uint64, int(lens.sum())), lens


def window_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; windows across list borders are the caller's to drop."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashed[k : k + n] + np.uint64(_STEP * (k + 1) & 0xFFFFFFFFFFFFFFFF))
    return out


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
