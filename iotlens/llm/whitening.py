"""Whitening of vectors by the covariance of distinct vectors weighted with their multiplicity.

Entries become integers ``x = floor(scale * entry) + shift``, so equal vectors are equal exactly.

1. *Multiplicity.*  Rows are grouped by the whole x vector (counted before the shuffle, so a vector that a third of all rows repeat
   is one row a task).  Counts are the fit weights; ``fit_weights=False`` fits every distinct vector with weight one.
2. *Sums.*  n and the sums S by dimension are exact integers.
3. *Covariance.*  Each batch of distinct vectors adds ``Xc' (w Xc)`` with ``Xc = (n x - S) / n``, whose numerator is exact.  The
   matrices of all tasks add up by row; their size depends on the dimension only.
4. *Eigenvectors* of that one d x d matrix, on the driver.
5. *Whitening.*  Each distinct vector is projected once.  A second centred, weighted product over the results gives ``identity_error``.
6. *Join back.*  Vectors that more than a thousandth of all rows repeat (so at most 1000) are joined by broadcast, all others by a
   shuffle on x, so that no vector is a hot key.

Vectors that are null, empty or hold null or non-finite entries take no part, nor do vectors of another length than the most common
one (of equally common ones the longest), nor those with an entry whose x is beyond ``LARGEST``.  Null and repeated ids are rows like others.
Components whose eigenvalue is not above rounding have null ``whitened`` and don't enter ``identity_error``, which is null without any.
Eigenvectors have their largest entry positive.  Deviations beyond 64 bits raise.  Fewer dimensions than ``components`` give fewer
components, an empty table gives no rows.  Only the id and the vector are read, so extra columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotlens.llm.common import stored

LARGEST = 1 << 40  # so that sums over 2^22 entries of one batch stay exact in 64 bits
BATCH = 1 << 13


def integers(df: DataFrame, vec_id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """``vec_id, x`` of the rows that take part, whatever their length."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < F.lit(float(LARGEST))))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift))
    return df.filter((F.size(vector) > 0) & sound).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _matrix(b: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, b.num_rows, BATCH):
        yield b.slice(k, BATCH)


def _sums(d: int):
    """A task's weighted sum of every dimension, as decimal text, exact at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            for p in _parts(b):
                w, x = p.column("weight").to_numpy(), _matrix(p, "x", d)
                wide = int(w.sum()) * int(np.abs(x).max(initial=0)) >= 1 << 62
                sums = (w.astype(object) @ x.astype(object)) if wide else w @ x
                total = [a + int(v) for a, v in zip(total, sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total))], ["dim", "total"])

    return run


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``: exact integers."""
    wide = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) >= 1 << 62
    return x.astype(object) * n - np.array(sums, object) if wide else x * n - np.array(sums, np.int64)


def _products(values: str, d: int, centre):
    """A task's weighted product of centred rows, one row of the matrix a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            for p in _parts(b):
                c = centre(_matrix(p, values, d))
                total += c.T @ (c * p.column("weight").to_numpy()[:, None].astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "line"])

    return run


def _covariance(df: DataFrame, values: str, d: int, n: int, centre) -> np.ndarray:
    """d x d, added over tasks by (row, column)."""
    lines = df.select(values, "weight").mapInArrow(_products(values, d, centre), "row int, line array<double>")
    cells = lines.select("row", F.posexplode("line").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for r in cells:
        out[r["row"], r["col"]] = r["v"]
    return (out + out.T) / (2 * n)


def _whiten(d: int, n: int, sums: list[int], turn: np.ndarray):
    """Whitened values and deviation of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in _parts(b):
                c = _centred(_matrix(p, "x", d), n, sums)
                most = int(np.abs(c).max(initial=0))
                square = (c.astype(object) ** 2).sum(1) if most * most * d >= 1 << 63 else (c * c).sum(1)
                if len(square) and int(max(square)) >= 1 << 63:
                    raise OverflowError("a deviation is beyond 64 bits")
                z = c.astype(np.float64) / n @ turn
                yield pa.RecordBatch.from_arrays(
                    [p.column("x"), p.column("n"), p.column("weight"), pa.array(square.astype(np.int64)), pa.array(list(z), pa.list_(pa.float64()))],
                    ["x", "n", "weight", "deviation", "z"])

    return run


def whiten(df: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000, fit_weights: bool = True) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component."""
    spark = df.sparkSession
    id_type = df.schema[vec_id].dataType.simpleString()
    rows = stored(integers(df, vec_id, vector, scale, shift), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    weight = F.col("n") if fit_weights else F.lit(1).cast("long")
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("n")).withColumn("weight", weight), "whitening-distinct")
    n_rows, n = (int(v) for v in distinct.agg(F.sum("n"), F.sum("weight")).first())
    added = distinct.select("x", "weight").mapInArrow(_sums(d), "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {r["dim"]: int(r["total"]) for r in added.collect()}  # one row a dimension
    sums = [totals[k] for k in range(d)]
    v = _covariance(distinct, "x", d, n, lambda x: _centred(x, n, sums).astype(np.float64) / n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    e = values[order]
    sound = e > max(0.0, float(values.max())) * d * np.finfo(np.float64).eps
    turn = np.where(sound, vectors / np.sqrt(np.where(sound, e, 1.0)), 0.0)
    made = stored(distinct.mapInArrow(_whiten(d, n, sums, turn), "x array<long>, n long, weight long, deviation long, z array<double>"), "whitening-values")
    m = len(order)
    first = made.select(*[(F.sum(F.col("weight") * F.get("z", F.lit(k))) / F.lit(n)).alias(f"m{k}") for k in range(m)]).first()
    means = np.array([first[k] for k in range(m)])
    c = _covariance(made, "z", m, n, lambda z: z - means)[np.ix_(sound, sound)]
    error = float(np.abs(c - np.eye(len(c))).max()) if len(c) else None
    trace = float(np.trace(v))
    facts = [(k + 1, float(e[k] / trace) if trace > 0 else None, bool(sound[k])) for k in range(m)]
    heavy = made.filter(F.col("n") * 1000 > n_rows).select(F.col("x").alias("hx"), F.col("deviation").alias("hd"), F.col("z").alias("hz"))
    light = made.filter(F.col("n") * 1000 <= n_rows).select("x", "deviation", "z")
    placed = rows.join(F.broadcast(heavy), F.col("x") == F.col("hx"), "left")
    common = placed.filter(F.col("hx").isNotNull()).select("vec_id", F.col("hd").alias("deviation"), F.col("hz").alias("z"))
    rest = placed.filter(F.col("hx").isNull()).select("vec_id", "x").join(light, "x").select("vec_id", "deviation", "z")
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("component"), (F.get("z", F.lit(k - 1)) if ok else F.lit(None).cast("double")).alias("whitened"), F.lit(share).cast("double").alias("explained"))
        for k, share, ok in facts])).alias("c")
    return common.unionByName(rest).select("vec_id", "deviation", each).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
