"""Uncertainty, effect sizes and two-sample tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.functions.numeric import two_sided_p
from iotlens.operators import ranks as R

DATASET_SIZE = 11209
REPLICATES = 5000
# Counts up to this use the exact Poisson inverse; larger ones the rounded normal.
SMALL_COUNT = 8
# Fixed values of the keyed mixing: a prime field where x -> x^5 is one-to-one, and round constants.
FIELD = (1 << 31) - 1
ROUNDS = [1, 1013904223, 362437069, 521288629, 88675123]


def with_uniform(df: DataFrame, value_key: Column, draw_key: Column, seed: int, name: str) -> DataFrame:
    """Adds a uniform number in (0, 1) that depends only on the two integer keys and the seed.

    Each round adds a key and a constant and takes the fifth power in the field, which scrambles
    the keys with whole-number arithmetic inside generated code.  Draw key and seed take turns, so
    draws of one seed are not those of another seed shifted.
    """
    df = df.select("*", F.pmod(value_key, F.lit(FIELD)).cast("long").alias("_x"), draw_key.cast("long").alias("_k"))
    for turn, c in enumerate(ROUNDS):
        df = df.withColumn("_x", (F.col("_x") + (F.lit(seed % FIELD) if turn % 2 else F.col("_k")) + c) % FIELD)
        df = df.withColumn("_x2", F.col("_x") * F.col("_x") % FIELD)
        df = df.withColumn("_x4", F.col("_x2") * F.col("_x2") % FIELD)
        df = df.withColumn("_x", F.col("_x4") * F.col("_x") % FIELD)
    return df.withColumn(name, (F.col("_x") + 0.5) / float(FIELD)).drop("_x", "_x2", "_x4", "_k")


def _poisson_cdf(mean: Column) -> Column:
    """Cumulative probabilities of Poisson(mean) for 0, 1, 2, ... up to a negligible tail."""
    top = (mean + 6 * F.sqrt(mean) + 8).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def grow(acc, k):
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), top), start, grow, lambda acc: acc["cdf"])


def _poisson_inverse(u: Column) -> Column:
    """Smallest k with ``u <= _cdf[k]``; branches stop at the first hit."""
    longest = int(SMALL_COUNT + 6 * SMALL_COUNT**0.5 + 8) + 1
    out = F.when(u <= F.get("_cdf", F.lit(0)), 0.0)
    for k in range(1, longest):
        out = out.when(u <= F.get("_cdf", F.lit(k)), float(k))
    return out.otherwise(F.size("_cdf").cast("double"))


def resampled(counts: DataFrame, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """Each (value, replicate) with its resampling weight.

    ``counts`` holds one row per group and distinct value with its count ``n``.  The weight
    of a value held by ``n`` rows is Poisson(n), drawn by an inverse cumulative from a number
    that depends on (seed, value, replicate) alone.  Resamples therefore do not depend on
    partitioning and rows are never copied.
    """
    mean = F.col("n").cast("double")
    small = F.col("n") <= SMALL_COUNT
    cdf = F.when(small, _poisson_cdf(F.least(mean, F.lit(float(SMALL_COUNT)))))
    draws = counts.select("*", cdf.alias("_cdf"), F.floor(F.col(value) * 1e9 + 0.5).alias("_key")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    )
    draws = with_uniform(draws, F.col("_key"), F.col("replicate"), seed, "_u")
    # Short steps: a generated method beyond the JIT compiler's size limit would run interpreted.
    u = F.col("_u")
    draws = draws.withColumn("_t", F.when(~small, _tail_root(u)))
    draws = draws.withColumn("_z", normal_from_root(u, F.col("_t")))
    large = F.greatest(F.lit(0.0), F.floor(mean + F.sqrt(mean) * F.col("_z") + 0.5))
    draws = draws.withColumn("_large", large)
    weight = F.when(small, _poisson_inverse(u)).otherwise(F.col("_large"))
    return draws.select(*counts.columns, "replicate", weight.alias("weight"))


# Rational approximation of the normal quantile (Abramowitz & Stegun 26.2.23).
_QC = [2.515517, 0.802853, 0.010328]
_QD = [1.432788, 0.189269, 0.001308]


def _tail_root(u: Column) -> Column:
    return F.sqrt(F.log(F.least(u, F.lit(1.0) - u)) * -2.0)


def normal_from_root(u: Column, t: Column) -> Column:
    """Normal quantile of ``u`` from ``t = sqrt(-2 ln(min(u, 1 - u)))``."""
    top = F.lit(_QC[0]) + t * _QC[1] + t * t * _QC[2]
    bottom = F.lit(1.0) + t * _QD[0] + t * t * _QD[1] + t * t * t * _QD[2]
    z = t - top / bottom
    return F.when(u < 0.5, -z).otherwise(z)


Statistic = Callable[[Column], Column]


def weighted_mean(value: str) -> Statistic:
    return lambda w: F.sum(w * F.col(value)) / F.sum(w)


def weighted_share(value: str, limit: float) -> Statistic:
    return lambda w: F.sum(F.when(F.col(value) >= limit, w).otherwise(0.0)) / F.sum(w)


def bootstrap_ci(
    df: DataFrame,
    value: str,
    groups: list[str],
    statistics: Mapping[str, Statistic],
    *,
    replicates: int = REPLICATES,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Percentile interval of each weighted statistic per group.

    A statistic is an aggregate of a weight column.  Work is (distinct values x replicates),
    summed before the shuffle to one row per group and replicate.
    """
    counts = R.spread_out(R.value_counts(df, groups, value))
    per = resampled(counts, value, replicates, seed).groupBy(*groups, "replicate").agg(
        *[fn(F.col("weight")).alias(n) for n, fn in statistics.items()]
    )
    lo, hi = (1.0 - level) / 2.0, (1.0 + level) / 2.0
    # `replicates` rows per group, so the built-in exact percentile is safe here.
    return per.groupBy(*groups).agg(
        *[F.percentile(n, q).alias(f"{n}_{side}") for n in statistics for side, q in (("lo", lo), ("hi", hi))]
    )


def cohen_d(df: DataFrame, value: str, in_a: Column, in_b: Column) -> DataFrame:
    a, b = F.when(in_a, F.col(value)), F.when(in_b, F.col(value))
    parts = df.agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb")
    )
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2.0)
    return parts.select(F.when(pooled == 0, F.lit(0.0)).otherwise((F.col("ma") - F.col("mb")) / pooled).alias("cohen_d"))


def mann_whitney(df: DataFrame, value: str, in_a: Column, in_b: Column) -> DataFrame:
    """Two-sided U test by mid-ranks with tie correction and continuity correction.

    Null results when a side has fewer than two rows.
    """
    counts = df.filter(F.col(value).isNotNull() & (in_a | in_b)).groupBy(value).agg(
        F.count_if(in_a).alias("na"), F.count_if(in_b).alias("nb")
    ).withColumn("n", F.col("na") + F.col("nb"))
    ranked = R.cumulative(counts, [], value)
    n = F.col("n").cast("double")
    sums = ranked.agg(
        F.sum("na").cast("double").alias("a"),
        F.sum("nb").cast("double").alias("b"),
        F.sum(F.col("na") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    )
    a, b = F.col("a"), F.col("b")
    total = a + b
    u = F.col("rank_sum") - a * (a + 1) / 2.0
    high = F.greatest(u, a * b - u)
    sd = F.sqrt(a * b / 12.0 * (total + 1 - F.col("ties") / (total * (total - 1))))
    out = sums.filter((a >= 2) & (b >= 2)).select(u.alias("statistic"), ((high - a * b / 2.0 - 0.5) / sd).alias("z"))
    p = F.least(F.lit(1.0), F.when(F.col("z") < 0, F.lit(2.0) - two_sided_p("z")).otherwise(two_sided_p("z")))
    return out.select("statistic", p.alias("p_value")).withColumn("significant_p005", F.col("p_value") < 0.05)


def f1_interval(results: DataFrame, n: int = DATASET_SIZE) -> DataFrame:
    """Normal-approximation interval of macro F1 per result row; ``n`` is the dataset size."""
    f1 = F.col("f1_macro")
    se = F.sqrt(f1 * (F.lit(1.0) - f1) / float(n))
    return results.withColumn("f1_macro_se", se).withColumns(
        {
            "f1_macro_ci95_lo": F.greatest(F.lit(0.0), f1 - F.col("f1_macro_se") * 1.96),
            "f1_macro_ci95_hi": F.least(F.lit(1.0), f1 + F.col("f1_macro_se") * 1.96),
        }
    )


def model_ztest(
    results: DataFrame, champion: str, *, split: str = "grouped_cv", feature_set: str = "full", n: int = DATASET_SIZE
) -> DataFrame:
    """Champion against every other model on one split and feature set."""
    rows = results.filter((F.col("split") == split) & (F.col("feature_set") == feature_set))
    best = rows.filter(F.col("model") == champion).select("split", F.col("f1_macro").alias("champion_f1"))
    other = rows.filter(F.col("model") != champion).select("split", "model", F.col("f1_macro").alias("other_f1"))
    c, o = F.col("champion_f1"), F.col("other_f1")
    se = F.sqrt(c * (F.lit(1.0) - c) / float(n) + o * (F.lit(1.0) - o) / float(n))
    z = F.when(F.col("se_diff") > 0, F.col("delta_f1") / F.nullif(F.col("se_diff"), F.lit(0.0))).otherwise(F.lit(float("inf")))
    tested = other.join(best, "split").select("model", "champion_f1", "other_f1", (c - o).alias("delta_f1"), se.alias("se_diff"))
    tested = tested.withColumn("z_score", z)
    p = F.when(F.col("se_diff") > 0, two_sided_p("z_score")).otherwise(F.lit(0.0))
    return tested.withColumn("p_value", p).withColumn("significant_p005", F.col("p_value") < 0.05)


def generalization_gap(results: DataFrame, feature_sets: tuple[str, ...] = ("full", "normalized_plus_pid")) -> DataFrame:
    """In-protocol minus cross-protocol macro F1 per feature set and model.

    A score or gap of exactly 0 counts as absent, as in the published table.
    """

    def at(split: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col("f1_macro")))

    wide = results.filter(F.col("feature_set").isin(*feature_sets)).groupBy("feature_set", "model").agg(
        at("grouped_cv").alias("in_protocol"),
        at("cross_coap_to_mqtt").alias("cross_coap_to_mqtt"),
        at("cross_mqtt_to_coap").alias("cross_mqtt_to_coap"),
    )

    def gap(cross: str) -> Column:
        present = (F.col("in_protocol") != 0) & (F.col(cross) != 0)
        return F.when(present, F.col("in_protocol") - F.col(cross))

    wide = wide.withColumns({"gap_coap_to_mqtt": gap("cross_coap_to_mqtt"), "gap_mqtt_to_coap": gap("cross_mqtt_to_coap")})
    both = (F.col("gap_coap_to_mqtt") != 0) & (F.col("gap_mqtt_to_coap") != 0)
    return wide.withColumn(
        "mean_generalization_gap", F.when(both, (F.col("gap_coap_to_mqtt") + F.col("gap_mqtt_to_coap")) / 2.0)
    )


def best_model(results: DataFrame, *, split: str = "grouped_cv", feature_set: str | None = None) -> DataFrame:
    """Result row with the highest macro F1 (name breaks ties)."""
    rows = results.filter(F.col("split") == split)
    if feature_set:
        rows = rows.filter(F.col("feature_set") == feature_set)
    return rows.orderBy(F.desc("f1_macro"), "model", "feature_set").limit(1)


def champion(
    candidates: DataFrame, *, within: float = 0.01, p99_ms: float = 1.0, size_mb: float = 10.0
) -> DataFrame:
    """Best candidate whose F1 is near the best and whose latency and size fit the limits.

    ``candidates``: ``model``, ``f1_macro``, ``p99_ms``, ``size_mb``.
    """
    best = candidates.agg(F.max("f1_macro").alias("best_f1")).withColumn("_k", F.lit(1))
    fit = candidates.withColumn("_k", F.lit(1)).join(best, "_k").filter(
        (F.col("f1_macro") >= F.col("best_f1") - within) & (F.col("p99_ms") < p99_ms) & (F.col("size_mb") < size_mb)
    )
    return fit.drop("_k").orderBy(F.desc("f1_macro"), "model").limit(1)
