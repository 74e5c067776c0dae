"""Spark's boosted trees, one class against the rest, grown a class a task.

Spark's learner runs a job for every level of every tree of every class.  Here the rows of a fit go packed to one task a class,
which grows all trees of that class.  Rows of one class with equal bins have one residual and are added up first.  The splits of
features, the draws of rows and features, the loss, the gains and their ties, the rules for leaves and the pruning are Spark's, and
the result is Spark's model.  Spark finds the splits on a sample beyond ``maxBins`` squared rows; here all rows count.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotlens.session import shared_dir

# A task holds every row of a fit: a byte a feature and some ten numbers each.  Beyond so many rows Spark's learner is used.
MOST_ROWS = 1_000_000
EPSILON = 2.0**-52
PACKED = "part int, seq int, size int, block binary"
_FULL, _HALF = (1 << 64) - 1, (1 << 32) - 1


def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & _HALF
        k = (k << 15 | k >> 17) & _HALF
        h ^= k * 0x1B873593 & _HALF
        h = ((h << 13 | h >> 19) & _HALF) * 5 + 0xE6546B64 & _HALF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _HALF
    h = (h ^ h >> 13) * 0xC2B2AE35 & _HALF
    return h ^ h >> 16


def _hashed(seed: int) -> int:
    """First state of Spark's xorshift generator."""
    data = (seed & _FULL).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _longs(seed: int) -> Iterator[int]:
    """Whole numbers of Java's generator."""
    state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1
    while True:
        halves = []
        for _ in range(2):
            state = state * 0x5DEECE66D + 0xB & (1 << 48) - 1
            half = state >> 16
            halves.append(half - (1 << 32) if half >> 31 else half)
        yield (halves[0] << 32) + halves[1]


def _units(seed: int) -> Iterator[float]:
    """Numbers in [0, 1) of Spark's xorshift generator."""
    state = _hashed(seed)
    while True:
        bits = []
        for width in (26, 27):
            state ^= state << 21 & _FULL
            state ^= state >> 35
            state ^= state << 4 & _FULL
            bits.append(state & (1 << width) - 1)
        yield ((bits[0] << 27) + bits[1]) * 2.0**-53


def _subsets(features: int, kept: int, seed: int) -> Iterator[list[int]]:
    """Features of one node after the other: a reservoir of ``kept`` in Spark's order."""
    for drawn in _longs(seed):
        found, units = list(range(kept)), _units(drawn)
        for item in range(kept, features):
            at = int(next(units) * (item + 1))
            if at < kept:
                found[at] = item
        yield found


def _drawn(sizes: Sequence[int], trees: int, rate: float, seed: int) -> np.ndarray:
    """Rows drawn for each tree, one bit a tree: every partition has its generator."""
    first = [[_hashed(seed + t + p + 1) for p in range(len(sizes))] for t in range(trees)]
    state, left = np.array(first, dtype=np.uint64), np.array(sizes)
    out = [np.empty(((trees + 7) // 8, n), np.uint8) for n in sizes]
    for row in range(max(sizes)):
        bits = []
        for width in (26, 27):
            state ^= state << np.uint64(21)
            state ^= state >> np.uint64(35)
            state ^= state << np.uint64(4)
            bits.append(state & np.uint64((1 << width) - 1))
        got = np.packbits(((bits[0] << np.uint64(27)) + bits[1]) * 2.0**-53 < rate, axis=0)
        for p in np.flatnonzero(left > row):
            out[p][:, row] = got[:, p]
    return np.concatenate(out, axis=1)


def _thresholds(x: np.ndarray, w: np.ndarray, splits: int) -> np.ndarray:
    """At most so many thresholds of a feature: between all values, or those nearest to equal shares of the weight."""
    x = x + 0.0  # one zero
    values, inverse = np.unique(x, return_inverse=True)
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) <= splits:
        return between
    weights = np.bincount(inverse, weights=w)
    stride, out, seen = weights.sum() / (splits + 1), [], weights[0]
    target = stride
    for k in range(1, len(values)):
        before, seen = seen, seen + weights[k]
        if abs(before - target) < abs(seen - target):
            out.append(between[k - 1])
            target += stride
    return np.array(out)


def _variance(count, total, squares):
    return (squares - total * total / count) / count


class _Table:
    """Rows of a fit by bins; ``groups`` are features of about as many bins, for sums over an array each."""

    def __init__(self, columns: Iterator[np.ndarray], w: np.ndarray, most_bins: int):
        splits = min(most_bins, len(w)) - 1
        self.thresholds, bins, self.features = [], [], []
        for f, x in enumerate(columns):
            found = _thresholds(x, w, splits)
            if len(found):
                self.thresholds.append(found)
                self.features.append(f)
                bins.append(np.searchsorted(found, x, side="left").astype(np.uint8 if most_bins <= 256 else np.uint16))
            count = f + 1
        self.bins = np.array(bins).reshape(len(bins), len(w))
        self.place = np.full(count, len(bins))
        self.place[self.features] = np.arange(len(bins))
        widths = [1 << len(t).bit_length() for t in self.thresholds]
        self.groups = [(b, [i for i, width in enumerate(widths) if width == b]) for b in sorted(set(widths))]

    def merged(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keeps one row of each kind, that is of equal bins and label: they have one residual.  Gives the labels and each row's kind."""
        keys = np.ascontiguousarray(np.concatenate([self.bins, (label > 0)[None].astype(self.bins.dtype)]).T)
        _, first, kind = np.unique(keys.view([("", keys.dtype, keys.shape[1])]).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(first)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.bins = np.ascontiguousarray(self.bins[:, first[order]])
        return label[first[order]], place[kind]


def _best_splits(table: _Table, bins: np.ndarray, slot: np.ndarray, nodes: int, sums: Sequence[np.ndarray], impurity, order):
    """For each node and feature the best gain (minus infinity: none), its bin, and the sums of its left side and of the node.

    Without ``impurity`` there is one node, the root: its sums are those of the first split that is looked at.
    """
    some = len(table.features)
    gains, at = np.full((nodes, some + 1), -np.inf), np.zeros((nodes, some), dtype=int)
    lefts, totals = np.zeros((3, nodes, some)), np.zeros((3, nodes, some))
    done = []
    for width, members in table.groups:
        start, cells = slot * width, nodes * width
        cum = np.empty((3, nodes, len(members), width))
        for j, f in enumerate(members):
            cell = start + bins[f]
            for s, values in enumerate(sums):
                cum[s, :, j] = np.bincount(cell, values, cells).reshape(nodes, width)
        last = width - 1 - np.argmax(cum[0, :, :, ::-1] > 0, axis=2)
        np.cumsum(cum, axis=3, out=cum)
        done.append((members, cum, last))
        totals[:, :, members] = cum[..., -1]
    root = None
    if impurity is None:
        first = next((table.place[f] for f in order if table.place[f] < some), None)
        if first is not None:
            cum = next(cum[:, 0, members.index(first)] for members, cum, _ in done if first in members)
            root = cum[:, 0] + (cum[:, -1] - cum[:, 0])
        impurity = np.array([0.0 if root is None else _variance(*root)])
    for members, cum, last in done:
        total = cum[..., -1:]
        right = total - cum
        with np.errstate(divide="ignore", invalid="ignore"):
            both = cum[0] + right[0]
            gain = impurity[:, None, None] - cum[0] / both * _variance(*cum) - right[0] / both * _variance(*right)
            fits = (cum[0] > 0) & (np.arange(cum.shape[3]) < last[..., None]) & (gain >= 0)
        gain[~fits] = -np.inf
        best = np.argmax(gain, axis=2)
        picked = best[None, :, :, None]
        gains[:, members] = np.take_along_axis(gain, picked[0], 2)[..., 0]
        at[:, members] = best
        lefts[:, :, members] = np.take_along_axis(cum, picked, 3)[..., 0]
    return gains, at, lefts, totals, root


def _grow(table: _Table, y: np.ndarray, weights: np.ndarray, used: np.ndarray, depth: int, subsets: Iterator[list[int]] | None):
    """A tree over kinds of rows, each for ``used`` rows of ``weights`` in all; kinds without a drawn row get their prediction too.

    A node is ``[sums, rows, impurity, gain, left, right, feature, threshold]``.
    """
    by = weights * y
    sums = [weights, by, by * y]
    bins, slot, rows = table.bins, np.zeros(len(y), dtype=np.int64), None
    out, tree, level_nodes, some = np.empty(len(y)), [[None, used.sum(), -1.0, -1.0, -1, -1, -1, 0.0]], [0], len(table.features)
    everything = list(range(len(table.place)))
    for level in range(depth):
        picks = [next(subsets) for _ in level_nodes] if subsets else [everything] * len(level_nodes)
        nodes = len(level_nodes)
        known = np.array([_variance(*tree[n][0]) for n in level_nodes]) if level else None
        gains, at, lefts, totals, root = _best_splits(table, bins, slot, nodes, sums, known, picks[0])
        if root is not None:
            tree[0][0] = tuple(map(float, root))
        wide = table.place[np.array(picks)]
        first = np.argmax(np.take_along_axis(gains, wide, 1), axis=1)
        chosen = wide[np.arange(nodes), first]
        children, after, feature, split = [-1] * (2 * nodes), [], np.zeros(nodes, dtype=int), np.zeros(nodes, dtype=int)
        value = np.zeros(2 * nodes)
        for k, n in enumerate(level_nodes):
            node, f = tree[n], chosen[k]
            gain = gains[k, f]
            if (wide[k] == some).all():
                here = slot == k
                node[0] = tuple(float(np.cumsum(v[here])[-1]) for v in sums)
            if not gain > 0:
                if gain == 0:
                    node[2] = _variance(*node[0])
                value[2 * k : 2 * k + 2] = _mean(node[0])
                continue
            feature[k], split[k] = f, at[k, f]
            sides = tuple(map(float, lefts[:, k, f])), tuple(float(t - s) for t, s in zip(totals[:, k, f], lefts[:, k, f]))
            node[2:] = [_variance(*node[0]), float(gain), len(tree), len(tree) + 1, table.features[f], float(table.thresholds[f][at[k, f]])]
            for side, child in enumerate(sides):
                spread = _variance(*child)
                children[2 * k + side] = len(tree)
                if level + 1 < depth and abs(spread) >= EPSILON:
                    after.append((2 * k + side, len(tree)))
                value[2 * k + side] = _mean(child)
                tree.append([child, 0, spread, -1.0, -1, -1, -1, 0.0])
        right = bins.ravel()[feature[slot] * len(slot) + np.arange(len(slot))] > split[slot] if some else np.zeros(len(slot), bool)
        side = 2 * slot + right
        for k, (n, count) in enumerate(zip(children, np.bincount(side, used, 2 * nodes))):
            if n >= 0:
                tree[n][1] = count
        after.reverse()  # Spark puts the left child on its stack, then the right one
        goes = np.full(2 * nodes, -1, dtype=np.int64)
        goes[[c for c, _ in after]] = np.arange(len(after))
        slot, ends = goes[side], value[side]
        stays = slot >= 0
        if not stays.all():
            away = ~stays
            if rows is None:
                out[away] = ends[away]
                rows = np.flatnonzero(stays)
            else:
                out[rows[away]] = ends[away]
                rows = rows[stays]
            bins, slot, used, sums = bins[:, stays], slot[stays], used[stays], [v[stays] for v in sums]
        level_nodes = [n for _, n in after]
        # A node that is split further is no leaf until its own split says so.
        for n in level_nodes:
            tree[n][2] = -1.0
        if not level_nodes:
            break
    return tree, out


def _mean(sums: Sequence[float]) -> float:
    return sums[1] / sums[0] if sums[0] else 0.0


def _saved(tree: list[list], number: int) -> Iterator[tuple]:
    """A tree's nodes as Spark stores them, in depth-first order; two leaves of one prediction become one."""
    value = [_mean(n[0]) for n in tree]
    for node, n in reversed(list(zip(tree, range(len(tree))))):  # children come after their parent
        left, right = node[4:6]
        if left >= 0 and tree[left][4] < 0 and tree[right][4] < 0 and value[left] == value[right]:
            value[n], node[3:] = value[left], [-1.0, -1, -1, -1, 0.0]
    ids, stack = {}, [0]
    while stack:
        n = stack.pop()
        ids[n] = len(ids)
        if tree[n][4] >= 0:
            stack += [tree[n][5], tree[n][4]]
    for n, at in ids.items():
        sums, rows, impurity, gain, left, right, feature, threshold = tree[n]
        inner = left >= 0
        split = (feature, [threshold], -1) if inner else (-1, [], -1)
        yield number, (at, value[n], float(impurity), list(sums), int(rows), gain, ids[left] if inner else -1, ids[right] if inner else -1, split)


def _features_per_node(strategy: str, features: int) -> int | None:
    """None: a strategy that is left to Spark."""
    if strategy in ("all", "auto"):
        return features
    try:
        share = float(strategy)
    except ValueError:
        return None
    return math.ceil(share * features) if 0 < share <= 1 and "." in strategy else None


def follows(learner) -> bool:
    """Whether a learner is one-against-rest boosting with the settings known here."""
    if not (isinstance(learner, OneVsRest) and isinstance(learner.getClassifier(), GBTClassifier)):
        return False
    inner = learner.getClassifier()
    plain = (inner.getMinInstancesPerNode(), inner.getMinInfoGain(), inner.getMinWeightFractionPerNode()) == (1, 0.0, 0.0)
    whole = not inner.isDefined(inner.validationIndicatorCol) and not inner.isDefined(inner.thresholds)
    return plain and whole and inner.getMaxDepth() > 0 and _features_per_node(inner.getFeatureSubsetStrategy(), 1) is not None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks of columns: label, weight, features."""
    for seq, batch in enumerate(batches):
        if batch.num_rows:
            part, y, w, x = (batch.column(i) for i in range(4))
            wide = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            block = np.concatenate([y.to_numpy()[None], w.to_numpy()[None], wide.T], dtype=float)
            yield pa.RecordBatch.from_pydict(
                {"part": part[:1], "seq": pa.array([seq], pa.int32()), "size": pa.array([batch.num_rows], pa.int32()),
                 "block": pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())})


def _trained(settings: dict) -> Callable[[Iterator], Iterator[tuple]]:
    """All trees of a class from the blocks of all rows."""
    rounds, rate, step, seed = (settings[k] for k in ("rounds", "rate", "step", "seed"))

    def run(blocks: Iterator) -> Iterator[tuple]:
        found = sorted((part, seq, size, block, own) for own, (part, seq, size, block) in blocks)
        if not found:
            return
        own, sizes = found[0][4], {}
        for part, _, size, _, _ in found:
            sizes[part] = sizes.get(part, 0) + size
        whole = np.concatenate([np.frombuffer(zlib.decompress(b), float).reshape(-1, size) for _, _, size, b, _ in found], axis=1)
        del blocks, found
        label, w = np.where(whole[0] == own, 1.0, -1.0), whole[1].copy()
        table = _Table((x for x in whole[2:]), w, settings["bins"])
        features = len(whole) - 2
        del whole
        # The number of an empty partition still counts.
        parts = [sizes.get(p, 0) for p in range(max(sizes) + 1)]
        drawn = _drawn(parts, rounds, rate, seed) if rate < 1 else None
        label, kind = table.merged(label)
        y, guess, kinds = label, np.zeros(len(label)), len(label)
        every = np.bincount(kind, w, kinds), np.bincount(kind).astype(float)
        for m in range(rounds):
            weights, used = every
            if drawn is not None:
                one = (drawn[m >> 3] >> (7 - (m & 7)) & 1).astype(float)
                weights, used = np.bincount(kind, w * one, kinds), np.bincount(kind, one, kinds)
            kept = settings["features"]
            subsets = _subsets(features, kept, seed + m) if kept < features else None
            tree, values = _grow(table, y, weights, used, settings["depth"], subsets)
            guess += values * (step if m else 1.0)
            with np.errstate(over="ignore"):
                y = 4.0 * label / (1.0 + np.exp(2.0 * label * guess))
            yield from _saved(tree, own * rounds + m)

    return run


class BoostedModel(GBTClassificationModel):
    """Spark's model.  Its list of parameters asks for every attribute but properties, and so would wrap all trees one by one."""

    @property
    def trees(self) -> list:
        return GBTClassificationModel.trees.func(self)


def _copies(classes: int):
    return lambda row: [(k, tuple(row)) for k in range(classes)]


def fit(learner: OneVsRest, rows: DataFrame, classes: int) -> OneVsRestModel:
    """The learner's model; draws go by the partitions of ``rows`` and their order inside."""
    spark, inner = rows.sparkSession, learner.getClassifier()
    weight = F.col(learner.getWeightCol()).cast("double") if learner.isDefined(learner.weightCol) else F.lit(1.0)
    columns = [F.spark_partition_id(), F.col(learner.getLabelCol()).cast("double"), weight, vector_to_array(learner.getFeaturesCol())]
    blocks = rows.select(*columns).mapInArrow(_packed, PACKED)
    features = len(rows.select(learner.getFeaturesCol()).first()[0])
    settings = {
        "rounds": inner.getMaxIter(), "rate": inner.getSubsamplingRate(), "step": inner.getStepSize(), "seed": inner.getSeed(),
        "bins": inner.getMaxBins(), "depth": inner.getMaxDepth(),
        "features": _features_per_node(inner.getFeatureSubsetStrategy(), features),
    }
    trained = blocks.rdd.flatMap(_copies(classes)).partitionBy(classes, int).mapPartitions(_trained(settings))
    own = {inner.labelCol: learner.getLabelCol(), inner.featuresCol: learner.getFeaturesCol(), inner.predictionCol: learner.getPredictionCol()}
    if learner.isDefined(learner.weightCol):
        own[inner.weightCol] = learner.getWeightCol()
    return learner._copyValues(OneVsRestModel(models=_models(spark, inner.copy(own), trained, features, classes)))


def _models(spark: SparkSession, booster: GBTClassifier, trained: RDD, features: int, classes: int) -> list[GBTClassificationModel]:
    """Models of all classes: Spark reads their trees from files of one model, whose pattern is a stored model of one tree over one row."""
    folder, rounds = f"{shared_dir(spark)}/boosters-{uuid.uuid4().hex}", booster.getMaxIter()
    names = [booster.getFeaturesCol(), booster.getLabelCol(), *([booster.getWeightCol()] if booster.isDefined(booster.weightCol) else [])]
    one = spark.createDataFrame([(Vectors.dense([0.0] * features), 1.0, 1.0)[: len(names)]], names)
    booster.copy({booster.maxIter: 1}).fit(one).save(f"{folder}/one")
    schema = spark.read.parquet(f"{folder}/one/data").schema
    spark.createDataFrame(trained, schema, verifySchema=False).write.parquet(f"{folder}/all/data")
    pattern = spark.read.parquet(f"{folder}/one/treesMetadata")
    tree = json.loads(pattern.first()[1])
    trees = [
        (k, json.dumps(tree | {"uid": f"dtr_{uuid.uuid4().hex[-12:]}"}), booster.getStepSize() if k % rounds else 1.0)
        for k in range(classes * rounds)
    ]
    spark.createDataFrame(trees, pattern.schema).coalesce(1).write.parquet(f"{folder}/all/treesMetadata")
    meta = json.loads(spark.read.text(f"{folder}/one/metadata").first()[0]) | {"numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/all/metadata")
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    every = getattr(jvm, meta["class"]).load(f"{folder}/all")
    kinds = getattr(jvm, "org.apache.spark.ml.regression.DecisionTreeRegressionModel"), jvm.double
    out = []
    for k in range(classes):
        own = [new(kind, rounds) for kind in kinds]
        for found, part in zip((every.trees(), every.treeWeights()), own):
            jvm.java.lang.System.arraycopy(found, k * rounds, part, 0, rounds)
        name = f"GBTClassifier_{uuid.uuid4().hex[-12:]}"
        out.append(booster._copyValues(BoostedModel(getattr(jvm, meta["class"])(name, *own, features))))
    return out
