"""Spark's perceptron over counted rows.

Spark's learner has no weights, so it reads equal rows one by one in each of its passes.  Its loss is a mean over rows, and equal
rows have equal loss: here a row stands for ``n`` equal ones.  The start, the network (sigmoid units, softmax with cross entropy),
L-BFGS with its line search and the rules of its end are Spark's, and the result is Spark's model.  Spark takes the mean by blocks,
so that a row of a partition's last, shorter block weighs more; here each row weighs the same.

The rows stay in their tasks.  Each pass sends out the weights and adds up one loss and gradient a task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 4096
# Those of Spark's L-BFGS: remembered steps, values that must have settled, tries of the line search and its two bounds.
MEMORY, SETTLED, TRIES, DECREASE, CURVATURE = 10, 20, 10, 1e-4, 0.9

Passes = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(Exception):
    """No step along a direction is good enough."""


def _batches(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    x, y, n = [], [], []
    for a, b, c in rows:
        x.append(a), y.append(b), n.append(c)
        if len(x) == BATCH:
            yield np.array(x, dtype=float), np.array(y, dtype=int), np.array(n, dtype=float)
            x, y, n = [], [], []
    if x:
        yield np.array(x, dtype=float), np.array(y, dtype=int), np.array(n, dtype=float)


def _unrolled(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offsets of every layer, as views."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _loss_sums(weights: np.ndarray, layers: Sequence[int]):
    """A task's sum of losses and gradients over all rows that its rows stand for."""

    def run(batches: Iterator) -> Iterator[tuple[float, np.ndarray]]:
        net, total, gradient = _unrolled(weights, layers), 0.0, np.zeros_like(weights)
        added = _unrolled(gradient, layers)
        for x, y, n in batches:
            seen = [x]
            for k, (w, b) in enumerate(net):
                z = seen[-1] @ w + b
                if k < len(net) - 1:
                    with np.errstate(over="ignore"):
                        z = 1.0 / (1.0 + np.exp(-z))
                seen.append(z)
            z = seen.pop()
            z -= z.max(axis=1, keepdims=True)
            logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            own = np.arange(len(y)), y
            total -= float(n @ logs[own])
            delta = np.exp(logs)
            delta[own] -= 1.0
            delta *= n[:, None]
            for (w, _), (dw, db), below in zip(net[::-1], added[::-1], seen[::-1]):
                dw += below.T @ delta
                db += delta.sum(axis=0)
                delta = (delta @ w.T) * below * (1.0 - below)
        yield total, gradient

    return run


def _added(a: tuple[float, np.ndarray], b: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _between(low: tuple, high: tuple) -> float:
    """The least point of the cubic through two points of the line, a tenth off either end."""
    (s, fs, ds), (t, ft, dt) = sorted((low, high))
    a = ds + dt - 3 * (fs - ft) / (s - t)
    root = a * a - ds * dt
    b = np.sqrt(root) if root >= 0 else np.nan
    found, width = t - (t - s) * (dt + b - a) / (dt - ds + 2 * b), t - s
    return float(min(max(found, s + 0.1 * width), s + 0.9 * width)) if np.isfinite(found) else s + 0.5 * width


def _step(line: Callable[[float], tuple[float, float]], start: tuple[float, float], first: float) -> float:
    """A step that meets the strong Wolfe conditions."""
    f0, d0 = start
    if d0 > 0:
        raise SearchFailed
    low, high, t = (0.0, f0, d0), None, first
    for i in range(TRIES):
        f, d = line(t)
        here = (t, f, d)
        if not np.isfinite(f):
            t /= 2.0
            continue
        if f > f0 + DECREASE * t * d0 or (f >= low[1] and i > 0):
            high = here
            break
        if abs(d) <= CURVATURE * abs(d0):
            return t
        if d >= 0:
            low, high = here, low
            break
        low, t = here, t * 1.5
    if high is None:
        raise SearchFailed
    for _ in range(TRIES):
        t = _between(low, high)
        f, d = line(t)
        if f > f0 + DECREASE * t * d0 or f >= low[1]:
            high = (t, f, d)
            continue
        if abs(d) <= CURVATURE * abs(d0):
            return t
        if d * (high[0] - low[0]) >= 0:
            high = low
        low = (t, f, d)
    raise SearchFailed


def _direction(gradient: np.ndarray, steps: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, shares = gradient.copy(), []
    for s, y in reversed(steps):
        shares.append(s @ q / (s @ y))
        q -= shares[-1] * y
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), share in zip(steps, reversed(shares)):
        q += s * (share - y @ q / (s @ y))
    return -q


def minimise(passes: Passes, x: np.ndarray, most: int, tol: float) -> np.ndarray:
    """L-BFGS; ``passes`` gives loss and gradient at a point."""
    f, g = passes(x)
    first, values, steps, failed = f, deque([f], SETTLED), deque(maxlen=MEMORY), False
    for k in range(most):
        if np.linalg.norm(g) <= max(tol * f, 1e-8):
            break
        way = _direction(g, steps)
        tried: dict[float, tuple[float, np.ndarray]] = {}

        def line(t: float) -> tuple[float, float]:
            tried.clear()  # only the last point is asked for again
            tried[t] = passes(x + t * way)
            return tried[t][0], float(tried[t][1] @ way)

        try:
            t = _step(line, (f, float(g @ way)), 1.0 if k else 1.0 / np.linalg.norm(way))
            if t * np.linalg.norm(g) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed = True
            steps.clear()
            continue
        x, (f, after) = x + t * way, tried[t]
        steps.append((t * way, after - g))
        g, failed = after, False
        values.append(f)
        if abs(f - max(values)) <= tol * abs(first):
            break
    return x


def _model(learner: MultilayerPerceptronClassifier, weights: np.ndarray | None, spark) -> MultilayerPerceptronClassificationModel:
    """Spark's model with given weights, or those that its learner starts from: a fit without a pass over one row."""
    row = (Vectors.dense([0.0] * learner.getLayers()[0]), 0.0)
    one = spark.createDataFrame([row], [learner.getFeaturesCol(), learner.getLabelCol()])
    set_to = {learner.maxIter: 0} | ({} if weights is None else {learner.initialWeights: Vectors.dense(weights)})
    return learner.copy(set_to).fit(one)


def fit(learner: MultilayerPerceptronClassifier, rows: DataFrame, count: str) -> MultilayerPerceptronClassificationModel:
    """The learner's model over rows that stand for ``count`` equal rows each."""
    spark, layers = rows.sparkSession, learner.getLayers()
    x, y = vector_to_array(learner.getFeaturesCol()), F.col(learner.getLabelCol())
    batches = rows.select(x, y, F.col(count).cast("double")).rdd.mapPartitions(_batches).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = rows.agg(F.sum(count)).first()[0]

        def passes(weights: np.ndarray) -> tuple[float, np.ndarray]:
            loss, gradient = batches.mapPartitions(_loss_sums(weights, layers)).treeReduce(_added)
            return loss / total, gradient / total

        start = np.array(_model(learner, None, spark).weights.toArray())
        return _model(learner, minimise(passes, start, learner.getMaxIter(), learner.getTol()), spark)
    finally:
        batches.unpersist()
