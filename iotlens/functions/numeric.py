"""Number helpers as Column expressions (all stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters must not be rewritten into.

    The planner pushes a filter through projections by inlining their expressions; where
    each step uses the previous one several times that multiplies the work.  A generator
    of one row computes the columns once and stops the rewrite.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def clamp01(x) -> Column:
    """Limit to [0, 1]; NaN becomes 0."""
    return F.greatest(F.lit(0.0), F.least(F.nanvl(_c(x).cast("double"), F.lit(0.0)), F.lit(1.0)))


def norm(x, cap) -> Column:
    """Share of a cap inside [0, 1]; a cap of 0 or less gives 0."""
    if isinstance(cap, (int, float)):
        return clamp01(_c(x) / F.lit(float(cap))) if cap > 0 else F.lit(0.0)
    cap = _c(cap)
    return F.when(cap <= 0, F.lit(0.0)).otherwise(clamp01(_c(x) / F.when(cap > 0, cap)))


def log_size(size) -> Column:
    """Log-scaled size: 0 for nothing, 1 from 4096 bytes on."""
    return clamp01(F.log1p(F.greatest(_c(size).cast("double"), F.lit(0.0))) / F.log1p(F.lit(4096.0)))


def size_per_resource(size, resource_bytes) -> Column:
    """Log-scaled bytes per byte of resource name, full at 64."""
    ratio = _c(size) / F.greatest(F.lit(1), _c(resource_bytes))
    return clamp01(F.log1p(ratio) / F.log1p(F.lit(64.0)))


def to_float(value, fallback: float = 0.0) -> Column:
    """Text to number with a fallback for anything unreadable."""
    return F.coalesce(F.trim(_c(value).cast("string")).try_cast("double"), F.lit(float(fallback)))


def prefix_float(value, fallback: float) -> Column:
    """Number at the start of a text (``60abc`` gives 60), else the fallback."""
    found = F.regexp_extract(_c(value), r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1)
    # An empty text would raise and catch an error inside the cast for every row.
    return F.coalesce(F.when(found != "", found).try_cast("double"), F.lit(float(fallback)))


def unit_or(value, fallback: float) -> Column:
    """Column form of a unit-interval setting: finite number inside [0, 1], else the fallback."""
    v = F.when(_c(value) == F.trim(_c(value)), _c(value).try_cast("double"))
    return F.when(v.between(0.0, 1.0) & ~F.isnan(v), v).otherwise(F.lit(float(fallback)))


def score_from_outputs(values) -> Column:
    """Model outputs to one score: the largest if all lie in [0, 1], else the sigmoid of the largest."""
    arr = _c(values)
    top = F.array_max(arr)
    bounded = F.forall(arr, lambda v: (v >= 0) & (v <= 1))
    return (
        F.when(F.size(arr) == 0, F.lit(0.0))
        .when(bounded, top)
        .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-top)))
    )


def overhead(base, other) -> tuple[Column, Column]:
    """Signed difference and percentage over the base (0 when the base is not positive)."""
    base, other = _c(base), _c(other)
    diff = other - base
    return diff, F.when(base > 0, diff / base * 100.0).otherwise(F.lit(0.0))


# Abramowitz & Stegun 7.1.26 (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_COEFFICIENTS = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def two_sided_p(z) -> Column:
    """Two-sided normal tail probability ``2 (1 - cdf(|z|))``."""
    x = F.abs(_c(z)) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_COEFFICIENTS):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def normal_cdf(z) -> Column:
    z = _c(z)
    half_tail = two_sided_p(z) / 2.0
    return F.when(z >= 0, F.lit(1.0) - half_tail).otherwise(half_tail)


def round6(x) -> Column:
    """Round to 6 places, with a small guard above the tie.

    Two engines that differ in the last bit of a sum then land on the same side.
    """
    return F.floor(_c(x) * 1e6 + 0.50001) / F.lit(1e6)


def pop_std(n, total, squares) -> Column:
    """Population standard deviation from exact integer sums; 0 below two rows.

    Works in decimal, so a flood of large packets neither overflows nor cancels.
    """
    n, total, squares = (_c(v).cast("decimal(19,0)") for v in (n, total, squares))
    spread = (n * squares - total * total).cast("double")
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))) / n.cast("double"))
