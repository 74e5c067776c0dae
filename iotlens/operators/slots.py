"""Exact sliding aggregates by hierarchical prefix sums, for keys with more rows in a bucket than one task should sort.

The running sums are those of ``sliding``, which sorts a (key, bucket) pair in one task and is faster for keys that are
sparse.  Here the unit of work is a slot of half a second:

* a row at time ``t`` adds at ``2 t``; its expiry for width ``w`` sits at ``2 (t + w) + 1``.
  Windows are closed at both ends and rows of equal time see each other.
* a key's timeline is cut into fine slots.  The entries of each slot are summed first, with
  partial sums before the shuffle; the few slot totals are scanned, slots inside a bucket and buckets
  inside a key; and each slot that has rows gets its starting value as one *carry* entry.  Rows are sorted only inside their
  slot, so a key with all rows of a minute is still worked on in as many pieces as the minute has slots.
* facts that reach back further than a window (time of the previous row, start of the
  session) are scanned and carried the same way, with maximum and minimum in place of the sum.
* distinct values become *spans*: per value and slot its first and last row.  Spans closer than the window are one island;
  an island adds one where it begins and takes it back when its last row expires.

Values must be whole numbers; sums are then exact and carry no drift.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotlens.settings import Slots

@dataclass(frozen=True)
class Facts:
    """A time that rows carry forward: ``at`` of each row, and ``upto``, its aggregate over the rows before."""

    at: Column
    keep: str  # "max" or "min"

    def over(self, column) -> Column:
        return F.max(column) if self.keep == "max" else F.min(column)


def slotted_sums(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    widths: Mapping[int, Mapping[str, Column]],
    *,
    distinct: Mapping[str, tuple[Column, int]] | None = None,
    facts: Mapping[str, Facts] | None = None,
    order: Sequence[str] = (),
    slots: Slots = Slots(),
) -> DataFrame:
    """Adds, for each width in micros, the named sums over ``[t - width, t]``.

    ``distinct`` maps a name to (value, width): distinct non-null values in the window.  ``facts`` are kept over all rows before
    a row in the order of ``t`` and ``order``; they appear as ``<name>_before`` and, with the row itself, as ``<name>_upto``.
    """
    distinct, facts = dict(distinct or {}), dict(facts or {})
    names = [n for group in widths.values() for n in group] + list(distinct)
    # Rows are dealt out by slot before anything is read from them; later steps move only entries without the row.
    dealt = df.select("*", F.expr(f"{t} div {slots.slot_us}L").alias("_slot")).repartition(*keys, "_slot")
    own, moved = _row_moves(dealt, df.columns, keys, t, widths, names, facts, order)
    for name, (value, width) in distinct.items():
        spans = _span_moves(dealt, keys, t, value, width, name, names, slots)
        moved = spans if moved is None else moved.unionByName(spans)
    entries = own
    if moved is not None:
        moved = moved.withColumn("_slot", F.expr(f"_pos div {2 * slots.slot_us}L"))
        entries = own.unionByName(moved, allowMissingColumns=True)
    placed = own.withColumn("_carry", F.lit(False))
    for other in [m for m in (moved, _carry(entries, keys, names, facts, slots)) if m is not None]:
        placed = placed.unionByName(other.repartition(*keys, "_slot"), allowMissingColumns=True)

    part = Window.partitionBy(*keys, "_slot")
    in_order = part.orderBy("_pos", F.desc_nulls_last("_carry"), *[f"_o_{n}" for n in order])
    made = []
    for name, fact in facts.items():
        made.append(fact.over(f"_f_{name}").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{name}_before"))
        made.append(fact.over(f"_f_{name}").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"{name}_upto"))
    upto = part.orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(f"_d_{n}").over(upto).alias(n) for n in names]
    extra = [f"{n}_{end}" for n in facts for end in ("before", "upto")]
    if made:  # before the sums: both orders start with the position, so one sort serves both
        placed = placed.select("_meta", *keys, "_slot", "_pos", *[f"_d_{n}" for n in names], *made)
    out = placed.select("_meta", *extra, *sums).filter(F.col("_meta").isNotNull())
    return out.select("_meta.*", *extra, *names)


def _row_moves(dealt, columns, keys, t, widths, names, facts, order) -> tuple[DataFrame, DataFrame | None]:
    """Each row's own entry, with the row in ``_meta``, and its expiries: one entry per width."""
    none = F.lit(0).cast("long")
    added = {n: c.cast("long") for group in widths.values() for n, c in group.items()}
    own = dealt.select(
        *keys, "_slot", (F.col(t) * 2).alias("_pos"), *[added.get(n, none).alias(f"_d_{n}") for n in names],
        F.struct(*[F.col(c) for c in columns]).alias("_meta"),
        *[f.at.cast("long").alias(f"_f_{n}") for n, f in facts.items()], *[F.col(n).alias(f"_o_{n}") for n in order])
    groups = {w: group for w, group in widths.items() if group}
    if not groups:
        return own, None
    # Flags read from text are computed once per row here, not once per generated entry.
    ready = dealt.select(*keys, F.col(t).alias("_at"), *[c.alias(f"_a_{n}") for n, c in added.items()])
    expiries = [
        F.struct(((F.col("_at") + w) * 2 + 1).alias("_pos"), *[(-F.col(f"_a_{n}") if n in group else none).alias(f"_d_{n}") for n in names])
        for w, group in groups.items()]
    return own, ready.select(*keys, F.inline(F.array(*expiries)))


def _span_moves(dealt, keys, t, value, width, name, names, slots: Slots) -> DataFrame:
    """Where a distinct value enters and leaves the window; rows are spans of a value in a slot before any sort.

    Spans near a bucket's ends are also shown to the neighbour, so that islands reach over slots.
    """
    per_bucket = _per_bucket(slots)
    spans = dealt.select(*keys, "_slot", F.col(t).alias("_at"), value.alias("_value")).groupBy(*keys, "_value", F.col("_slot").alias("_s")).agg(
        F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    reach = -(-width // slots.slot_us) + 1
    b = F.expr(f"_s div {per_bucket}L")
    shown = F.array_distinct(F.array(b, F.expr(f"(_s - {reach}L) div {per_bucket}L"), F.expr(f"(_s + {reach}L) div {per_bucket}L")))
    shown = spans.select("*", b.alias("_home"), F.explode(shown).alias("_b"))
    along = Window.partitionBy(*keys, "_value", "_b").orderBy("_lo")
    ends = shown.select("*", F.lag("_hi").over(along).alias("_last"), F.lead("_lo").over(along).alias("_next")).filter("_home = _b")
    # Nulls leave no marks; a filter on the value would be pushed below the exchange and read it from the rows a second time.
    known = F.col("_value").isNotNull()
    enters = F.col("_last").isNull() | (F.col("_lo") - F.col("_last") > width)
    leaves = F.col("_next").isNull() | (F.col("_next") - F.col("_hi") > width)

    def mark(pos: Column, step: int, cond: Column) -> Column:
        return F.when(cond, F.struct(pos.alias("_pos"), F.lit(step).cast("long").alias("_step")))

    marks = F.filter(F.array(mark(F.col("_lo") * 2, 1, known & enters), mark((F.col("_hi") + width) * 2 + 1, -1, known & leaves)), lambda m: m.isNotNull())
    none = F.lit(0).cast("long")
    return ends.select(*keys, F.inline(marks)).select(*keys, "_pos", *[(F.col("_step") if n == name else none).alias(f"_d_{n}") for n in names])


def _per_bucket(slots: Slots) -> int:
    return -(-slots.width_us // slots.slot_us)


def _carry(entries: DataFrame, keys, names, facts, slots: Slots) -> DataFrame:
    """One entry per slot that has rows: what all earlier slots of its key leave.

    Its size is that of the slots in use, whatever the number of rows.
    """
    how = {f"_d_{n}": F.sum for n in names} | {f"_f_{n}": f.over for n, f in facts.items()}
    totals = [f(c).alias(c) for c, f in how.items()]
    used = entries.groupBy(*keys, "_slot").agg(*totals, F.count("_meta").alias("_rows")).withColumn("_b", F.expr(f"_slot div {_per_bucket(slots)}L"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = used.groupBy(*keys, "_b").agg(*totals).select(*keys, "_b", *[f(c).over(before).alias(c) for c, f in how.items()])
    # A bucket's start sorts before its slots, as it has none, and is summed like one.
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col("_slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    scanned = used.unionByName(starts, allowMissingColumns=True).select(*keys, "_slot", "_rows", *[f(c).over(inside).alias(c) for c, f in how.items()])
    carried = [F.coalesce(c, F.lit(0)).cast("long").alias(c) if c.startswith("_d_") else F.col(c) for c in how]
    return scanned.filter("_slot IS NOT NULL AND _rows > 0").select(
        *keys, "_slot", ((F.col("_slot") - 1) * (2 * slots.slot_us)).alias("_pos"), *carried, F.lit(True).alias("_carry"))
