"""Exact sliding aggregates over per-key timelines, linear in the number of rows.

A frame ``RANGE BETWEEN w PRECEDING AND CURRENT ROW`` is re-aggregated each time its
bounds move, which is quadratic for a flood on one key.  Here every row adds its values
at its own position and takes them back at an expiry position, so all windows become
running sums:

* a row at time ``t`` adds at ``2 t``; its expiry for width ``w`` sits at ``2 (t + w) + 1``.
  Windows are closed at both ends and rows of equal time see each other.
* a key's timeline is split into buckets of fixed width.  Rows of the last ``w`` of a
  bucket are copied into the next one as *halo* rows that contribute but are not output.
  One (key, bucket) pair is one unit of work, so a hot key spreads over many tasks.
* facts that reach back further than a window (time of the previous row, start of the
  session) enter a bucket through one *seed* row, made from a per-bucket summary.

Everything after the single exchange on (keys, bucket) reuses its partitioning.
Values must be whole numbers; sums are then exact and carry no drift.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotlens.settings import LONG_WINDOW_US, Buckets

ROW, HALO, SEED = 0, 1, 2
LEAST_TASKS = 64


def dealt(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows exchanged by (keys, bucket) over a fixed number of tasks.

    Adaptive execution would fold tasks by the compressed bytes of the exchange, but each row becomes several entries that
    are sorted in memory after it.
    """
    tasks = max(LEAST_TASKS, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, *keys, "_b")


def _bucket_of(t: str, width: int) -> Column:
    return F.expr(f"{t} div {width}L")


def with_halo(df: DataFrame, t: str, halo_us: int, buckets: Buckets) -> DataFrame:
    """Adds ``_b`` (bucket) and ``_kind``; rows near a bucket's end also appear in the next one."""
    width = buckets.width_us
    if halo_us > width:
        raise ValueError("halo wider than a bucket")
    b = _bucket_of(t, width)
    home = F.struct(b.alias("_b"), F.lit(ROW).alias("_kind"))
    copy = F.struct((b + 1).alias("_b"), F.lit(HALO).alias("_kind"))
    near_end = F.col(t) % F.lit(width) >= width - halo_us
    places = F.when(near_end, F.array(home, copy)).otherwise(F.array(home))
    return df.select("*", F.inline(places))


def bucket_carry(
    df: DataFrame, keys: Sequence[str], t: str, carried: Mapping[str, tuple[Column, Column]], buckets: Buckets
) -> DataFrame:
    """One row per (keys, bucket) that has something to carry in from earlier buckets.

    ``carried`` maps a name to (aggregate per bucket, running form over earlier buckets)
    where the running form is an aggregate Column over the per-bucket value.
    The size is bounded by keys x buckets, whatever the number of rows.
    """
    width = buckets.width_us
    per_bucket = df.groupBy(*keys, _bucket_of(t, width).alias("_b")).agg(
        *[agg.alias(name) for name, (agg, _) in carried.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(
        *keys, "_b", *[running.over(earlier).alias(name) for name, (_, running) in carried.items()]
    )


def sliding_sums(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    widths: Mapping[int, Mapping[str, Column]],
    *,
    buckets: Buckets = Buckets(),
) -> DataFrame:
    """Adds, for each width in micros, the named sums over ``[t - width, t]``."""
    halo = max(widths)
    placed = dealt(with_halo(df, t, halo, buckets), keys)
    return running_sums(placed, df.columns, keys, t, widths, buckets)


def running_sums(
    placed: DataFrame,
    out_columns: Sequence[str],
    keys: Sequence[str],
    t: str,
    widths: Mapping[int, Mapping[str, Column]],
    buckets: Buckets,
    *,
    order: Sequence[str] = (),
    in_order: Mapping[str, Column] | None = None,
    track: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Second half of :func:`sliding_sums`, for rows already placed and exchanged by (keys, bucket).

    A value in ``widths`` is one column, or a pair (added at the row, taken back at expiry).
    ``track`` columns appear as ``_t_<name>`` to the ``in_order`` expressions, which use
    windows from :func:`row_order`.
    """
    track = dict(track or {})
    names = [name for group in widths.values() for name in group]

    def pair(value) -> tuple[Column, Column]:
        return value if isinstance(value, tuple) else (value, value)

    # Flags read from text are computed once per row here, not once per generated entry.
    none = F.lit(0).cast("long")
    seed = F.col("_kind") == SEED
    ready = {"_meta": F.when(F.col("_kind") == ROW, F.struct(*[F.col(c) for c in out_columns]))}
    for group in widths.values():
        for name, value in group.items():
            added, removed = pair(value)
            ready[f"_a_{name}"] = F.when(seed, none).otherwise(added.cast("long"))
            if removed is not added:
                ready[f"_r_{name}"] = F.when(seed, none).otherwise(removed.cast("long"))
    for name, col in track.items():
        ready[f"_t_{name}"] = col.cast("long")
    for name in order:
        ready[f"_o_{name}"] = F.col(name)
    rows = placed.select(*keys, "_b", F.col(t).alias("_at"), *[c.alias(n) for n, c in ready.items()])

    def entry(pos: Column, values: Mapping[str, Column], real: bool) -> Column:
        fields = [pos.alias("_pos"), *[values.get(n, none).alias(f"_d_{n}") for n in names]]
        extra = [n for n in ready if n.startswith(("_t_", "_o_")) or n == "_meta"]
        for n in extra:
            kind = rows.schema[n].dataType
            fields.append((F.col(n) if real else F.lit(None).cast(kind)).alias(n))
        return F.struct(*fields)

    entries = [entry(F.col("_at") * 2, {n: F.col(f"_a_{n}") for n in names}, True)]
    for width, group in widths.items():
        back = {n: -F.col(f"_r_{n}" if f"_r_{n}" in ready else f"_a_{n}") for n in group}
        entries.append(entry((F.col("_at") + width) * 2 + 1, back, False))
    moves = rows.select(*keys, "_b", F.inline(F.array(*entries)))
    # Expiries past the bucket's end are never read.
    moves = moves.filter(F.col("_pos") < (F.col("_b") + 1) * 2 * buckets.width_us)

    part = [*keys, "_b"]
    if in_order:
        moves = moves.select("*", *[col.alias(name) for name, col in in_order.items()])
    upto = Window.partitionBy(*part).orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(f"_d_{name}").over(upto).alias(name) for name in names]
    kept = ["_meta", *(in_order or {})]
    result = moves.select(*kept, *sums).filter(F.col("_meta").isNotNull())
    return result.select("_meta.*", *(in_order or {}), *names)


def row_order(keys: Sequence[str], order: Sequence[str]):
    """Window over all rows of a (keys, bucket) pair in arrival order."""
    return Window.partitionBy(*keys, "_b").orderBy("_pos", *[f"_o_{name}" for name in order])


def plain_sliding_sums(
    df: DataFrame, keys: Sequence[str], t: str, widths: Mapping[int, Mapping[str, Column]]
) -> DataFrame:
    """Small-data form with ordinary RANGE frames; the tests hold it equal to :func:`sliding_sums`."""
    out = df
    for width, group in widths.items():
        w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-width, Window.currentRow)
        out = out.withColumns({name: F.sum(col.cast("long")).over(w) for name, col in group.items()})
    return out


def distinct_marks(placed: DataFrame, keys: Sequence[str], t: str, value: str, width_us: int) -> DataFrame:
    """Marks where a value enters and leaves a sliding window of distinct values.

    Per (keys, bucket, value), rows closer than the width form one island.  ``_enter`` is 1
    on its first row and ``_leave`` is 1 on its last, so the running sum of enters minus
    expired leaves is the exact distinct count.  Needs no exchange after (keys, bucket).
    """
    w = Window.partitionBy(*keys, "_b", value).orderBy(t)
    before, after = F.lag(t).over(w), F.lead(t).over(w)
    known = F.col(value).isNotNull()
    return placed.select(
        "*",
        F.when(known & (before.isNull() | (F.col(t) - before > width_us)), 1).otherwise(0).alias("_enter"),
        F.when(known & (after.isNull() | (after - F.col(t) > width_us)), 1).otherwise(0).alias("_leave"),
    )


DEFAULT_HALO_US = LONG_WINDOW_US
