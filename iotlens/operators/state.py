"""Per-source window state: the facts behind the behavioral vector.

The state key is (protocol, source_id); input rows are client packets, including those
that are later denied.  Rows of equal time see each other in windows; "previous row" and
"latest session start" follow (t_us, event_id).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotlens.functions import detail as D
from iotlens.operators import sliding as S
from iotlens.operators.slots import Facts, slotted_sums
from iotlens.settings import GAP_CAP_MS, LONG_WINDOW_US, RATE_WINDOW_US, SHORT_WINDOW_US, Buckets, Slots

KEYS = ["protocol", "source_id"]
OPTION_SCALE = 1_000_000

_WINDOWED = {
    RATE_WINDOW_US: ["n1"],
    SHORT_WINDOW_US: ["n10", "err10", "hs10", "con10", "non10", "ack10", "rst10", "opt10", "resources10"],
    LONG_WINDOW_US: ["open30", "breadth30", "n30", "b30", "bb30"],
}
_IN_ORDER = ["gap_ms", "start_us"]
ALL = [*_IN_ORDER, *[n for names in _WINDOWED.values() for n in names]]


def state_key(protocol="protocol", source="source_id") -> Column:
    return F.concat(F.col(protocol), F.lit(":"), F.col(source))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _values() -> dict[str, Column]:
    coap = F.col("protocol") == "coap"
    kind = D.coap_type("detail")
    one = F.lit(1)
    return {
        "n1": one,
        "n10": one,
        "n30": one,
        "err10": _flag(D.has_error("detail")),
        "hs10": _flag(D.is_handshake("event", "detail")),
        "con10": _flag(coap & (kind == "con")),
        "non10": _flag(coap & (kind == "non")),
        "ack10": _flag(coap & (kind == "ack")),
        "rst10": _flag(coap & (kind == "rst")),
        "opt10": F.when(coap, F.round(D.option_count("detail") * OPTION_SCALE)).otherwise(0),
        "open30": _flag(D.is_open("event")),
        "breadth30": _flag(D.is_breadth("detail")),
        "b30": F.col("bytes"),
        "bb30": F.col("bytes") * F.col("bytes"),
    }


def source_state(
    events: DataFrame, needed: Iterable[str] = ALL, *, buckets: Buckets = Buckets(), slots: Slots | None = None
) -> DataFrame:
    """Adds the requested state columns to client packets (columns of ``events`` are kept).

    One exchange on (protocol, source_id, bucket) for the rows; only asked-for windows
    produce expiry rows.  ``gap_ms`` / ``start_us`` also need a summary of one row per
    source and bucket, read from three columns of the same input.

    With ``slots`` the work is dealt out by (protocol, source_id, slot) instead, for sources that flood a bucket; same rows.
    """
    needed = list(dict.fromkeys(needed))
    unknown = set(needed) - set(ALL)
    if unknown:
        raise ValueError(f"unknown state columns: {sorted(unknown)}")
    if slots is not None:
        return _slotted(events, needed, slots)
    values = _values()
    widths = {w: {n: values.get(n) for n in names if n in needed} for w, names in _WINDOWED.items()}
    widths = {w: group for w, group in widths.items() if group}
    ordered = [n for n in _IN_ORDER if n in needed]
    halo = max(widths, default=0)

    placed = S.with_halo(events, "t_us", halo, buckets) if halo else events.select(
        "*", S._bucket_of("t_us", buckets.width_us).alias("_b"), F.lit(S.ROW).alias("_kind")
    )
    track: dict[str, Column] = {}
    if ordered:
        carried = S.bucket_carry(
            events,
            KEYS,
            "t_us",
            {
                "_seen": (F.max("t_us"), F.max("_seen")),
                "_opened": (F.max(F.when(D.is_open("event"), F.col("t_us"))), F.max("_opened")),
                "_first": (F.min("t_us"), F.min("_first")),
            },
            buckets,
        )
        seeds = carried.filter(F.col("_seen").isNotNull()).select(
            *KEYS, "_b", F.lit(S.SEED).alias("_kind"),
            (F.col("_b") * buckets.width_us - 1).alias("t_us"),
            F.col("_seen"), F.coalesce("_opened", "_first").alias("_since"),
        )
        placed = placed.unionByName(seeds, allowMissingColumns=True)
        is_seed = F.col("_kind") == S.SEED
        track = {
            "seen": F.when(is_seed, F.col("_seen")).otherwise(F.col("t_us")),
            "since": F.when(is_seed, F.col("_since")).when(D.is_open("event"), F.col("t_us")),
        }
    placed = S.dealt(placed, KEYS)

    if "resources10" in needed:
        res = F.when(F.col("_kind") != S.SEED, F.nullif(D.resource("detail"), F.lit("")))
        placed = S.distinct_marks(placed.withColumn("_res", res), KEYS, "t_us", "_res", SHORT_WINDOW_US)
        widths[SHORT_WINDOW_US]["resources10"] = (F.col("_enter"), F.col("_leave"))

    in_order: dict[str, Column] = {}
    if ordered:
        w = S.row_order(KEYS, ["event_id"])
        if "gap_ms" in ordered:
            before = F.max("_t_seen").over(w.rowsBetween(Window.unboundedPreceding, -1))
            in_order["_before"] = before
        if "start_us" in ordered:
            upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            in_order["start_us"] = F.coalesce(F.max("_t_since").over(upto), F.min("_t_seen").over(upto))
    out = S.running_sums(
        placed, events.columns, KEYS, "t_us", widths, buckets,
        order=["event_id"] if ordered else [], in_order=in_order, track=track,
    )
    if "gap_ms" in ordered:
        gap = F.expr("(t_us - _before) div 1000L")
        out = out.withColumn("gap_ms", F.coalesce(gap, F.lit(GAP_CAP_MS).cast("long"))).drop("_before")
    return out


def _slotted(events: DataFrame, needed: list[str], slots: Slots) -> DataFrame:
    values = _values()
    widths = {w: {n: values[n] for n in names if n in needed and n in values} for w, names in _WINDOWED.items()}
    distinct = {"resources10": (F.nullif(D.resource("detail"), F.lit("")), SHORT_WINDOW_US)} if "resources10" in needed else {}
    facts: dict[str, Facts] = {}
    if "gap_ms" in needed:
        facts["_seen"] = Facts(F.col("t_us"), "max")
    if "start_us" in needed:
        facts["_opened"] = Facts(F.when(D.is_open("event"), F.col("t_us")), "max")
        facts["_first"] = Facts(F.col("t_us"), "min")
    order = ["event_id"] if facts else []
    out = slotted_sums(events, KEYS, "t_us", widths, distinct=distinct, facts=facts, order=order, slots=slots)
    if "gap_ms" in needed:
        out = out.withColumn("gap_ms", F.coalesce(F.expr("(t_us - _seen_before) div 1000L"), F.lit(GAP_CAP_MS).cast("long")))
    if "start_us" in needed:
        out = out.withColumn("start_us", F.coalesce("_opened_upto", "_first_upto"))
    return out.drop(*[f"{n}_{end}" for n in facts for end in ("before", "upto")])
