"""Per-source features on a stream, with the same results as the batch form.

State per (protocol, source): the rows of the last 30 seconds as parallel lists, the time of
the last row and the session start.  Rows of a micro-batch are put in event-time order per
source before they are applied.  With a delay, rows stay in the state until their source's newest
row is more than the delay ahead of them, so files in mixed order give the results of the batch form;
closing rows release what is left.  A row older than what its source has already applied is not
applied; it goes to the output with ``late = true`` so that it can be counted and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from iotlens.functions import detail as D
from iotlens.functions import entropy as E
from iotlens.operators import state, vectors
from iotlens.schemas import FEATURES
from iotlens.settings import GAP_CAP_MS, LONG_WINDOW_US, RATE_WINDOW_US, SHORT_WINDOW_US

# Facts of one row that windows need, taken from its text on the JVM side.
FLAGS = ["err10", "hs10", "con10", "non10", "ack10", "rst10", "opt10", "open30", "breadth30", "b30", "bb30"]
PASSED = ["event_id", "t_us", "direction", "event", "bytes", "detail", "payload_entropy", "mid"]
WIDTHS = {
    "n1": RATE_WINDOW_US,
    **dict.fromkeys(["n10", "err10", "hs10", "con10", "non10", "ack10", "rst10", "opt10"], SHORT_WINDOW_US),
    **dict.fromkeys(["n30", "open30", "breadth30", "b30", "bb30"], LONG_WINDOW_US),
}

_HISTORY = ["t_us", "event_id", "resource", *FLAGS]
HISTORY = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType() if n == "resource" else T.LongType())) for n in _HISTORY]
    + [T.StructField("since_us", T.LongType())]
)
# Rows that wait for their delay, as parallel lists.
_HELD = [*PASSED, "resource", *FLAGS]
_TYPES = {**dict.fromkeys(["direction", "event", "detail", "resource"], T.StringType()), "payload_entropy": T.DoubleType()}
HELD = T.StructType([T.StructField(n, T.ArrayType(_TYPES.get(n, T.LongType()))) for n in _HELD])
OUTPUT = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("direction", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("detail", T.StringType()),
        T.StructField("payload_entropy", T.DoubleType()),
        T.StructField("mid", T.LongType()),
        T.StructField("late", T.BooleanType()),
    ]
    + [T.StructField(n, T.LongType()) for n in state.ALL]
)


def windowed(rows: pd.DataFrame, since_us: int, last_us: int | None, fresh_from: int) -> pd.DataFrame:
    """State columns of ``rows`` (one source, in order) from position ``fresh_from`` on."""
    t = rows["t_us"].to_numpy()
    # Rows of equal time see each other, so a window ends after the last of them.
    end = np.searchsorted(t, t, side="right")
    out = {}
    for name, width in WIDTHS.items():
        begin = np.searchsorted(t, t - width, side="left")
        if name.startswith("n") and name not in FLAGS:
            out[name] = end - begin
        else:
            total = np.concatenate([[0], np.cumsum(rows[name].to_numpy(dtype=np.int64))])
            out[name] = total[end] - total[begin]
    out["resources10"] = _distinct(rows["resource"].to_numpy(dtype=object), t, end)
    before = np.concatenate([[t[0] if last_us is None else last_us], t[:-1]])
    gap = (t - before) // 1000
    if last_us is None:
        gap[0] = GAP_CAP_MS
    out["gap_ms"] = gap
    opened = np.where(rows["open30"].to_numpy() > 0, t, -1)
    opened[:fresh_from] = -1
    run = np.maximum.accumulate(opened)
    out["start_us"] = np.where(run >= 0, run, since_us)
    return pd.DataFrame(out).iloc[fresh_from:].reset_index(drop=True)


def _distinct(values: np.ndarray, t: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distinct non-null values per closed 10 s window, by islands of each value."""
    steps = np.zeros(len(t) + 1, dtype=np.int64)
    frame = pd.DataFrame({"v": values, "t": t}).dropna()
    if len(frame):
        by = frame.groupby("v", sort=False)["t"]
        first = (frame["t"] - by.shift(1)).isna() | (frame["t"] - by.shift(1) > SHORT_WINDOW_US)
        last = (by.shift(-1) - frame["t"]).isna() | (by.shift(-1) - frame["t"] > SHORT_WINDOW_US)
        np.add.at(steps, frame.index[first].to_numpy(), 1)
        gone = np.searchsorted(t, frame["t"][last].to_numpy() + SHORT_WINDOW_US, side="right")
        np.add.at(steps, gone, -1)
    return np.cumsum(steps)[end - 1]


class SourceWindows(StatefulProcessor):
    """Keeps the last 30 seconds of one source, and its rows of the last ``delay_us``."""

    def __init__(self, delay_us: int = 0):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getValueState("history", HISTORY)
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One trigger's rows of one source; the trigger's input limit and the delay bound their number.
        fresh = pd.concat(list(rows), ignore_index=True)
        ends = fresh["closing"].to_numpy(dtype=bool)
        fresh = fresh.loc[~ends, _HELD].sort_values(["t_us", "event_id"], ignore_index=True)
        old, since, last = self._restore()
        late = pd.Series(False, index=fresh.index)
        if last is not None:
            late = behind(fresh, last, self.delay_us)
        dropped, fresh = fresh[late], fresh[~late].reset_index(drop=True)
        if self.delay_us:
            fresh = release(self.held, HELD, fresh, self.delay_us, bool(ends.any()))
        if len(fresh):
            known = pd.concat([old, fresh[_HISTORY]], ignore_index=True) if len(old) else fresh[_HISTORY]
            since = int(fresh["t_us"].iloc[0]) if since is None else since
            facts = windowed(known, since, None if last is None else last[0], len(known) - len(fresh))
            self._keep(known, int(facts["start_us"].iloc[-1]))
            yield self._rows(key, fresh, facts, False)
        if len(dropped):
            blank = pd.DataFrame({n: [None] * len(dropped) for n in state.ALL}, dtype="Int64")
            yield self._rows(key, dropped.reset_index(drop=True), blank, True)

    def _rows(self, key, rows: pd.DataFrame, facts: pd.DataFrame, late: bool) -> pd.DataFrame:
        out = pd.concat([rows[PASSED], facts], axis=1)
        return out.assign(protocol=key[0], source_id=key[1], late=late)[[f.name for f in OUTPUT.fields]]

    def _restore(self):
        if not self.history.exists():
            return pd.DataFrame(columns=_HISTORY), None, None
        held = self.history.get()
        old = pd.DataFrame({n: list(held[i]) for i, n in enumerate(_HISTORY)})
        return old, held[len(_HISTORY)], (int(old["t_us"].iloc[-1]), int(old["event_id"].iloc[-1]))

    def _keep(self, known: pd.DataFrame, since: int) -> None:
        recent = known[known["t_us"] >= known["t_us"].iloc[-1] - LONG_WINDOW_US]
        lists = [
            [None if v is None or v != v else v for v in recent[n]] if n == "resource" else [int(v) for v in recent[n]]
            for n in _HISTORY
        ]
        self.history.update((*lists, since))

    def close(self) -> None:
        pass


def behind(rows: pd.DataFrame, last: tuple[int, int], delay_us: int) -> pd.Series:
    """Rows that come before the last applied one ``(t_us, event_id)``; with a delay, rows of its time have been applied together."""
    same = rows["t_us"] == last[0]
    return (rows["t_us"] < last[0]) | (same if delay_us else same & (rows["event_id"] < last[1]))


def release(held, schema: T.StructType, fresh: pd.DataFrame, delay_us: int, closing: bool) -> pd.DataFrame:
    """Rows, in order, that are more than the delay older than the newest one, or all at the end; the others stay in ``held``."""
    names = schema.fieldNames()
    if held.exists():
        kept = held.get()
        kept = pd.DataFrame({n: pd.Series(list(kept[i]), dtype=None if len(kept[i]) else object) for i, n in enumerate(names)})
        fresh = pd.concat([kept, fresh[names]], ignore_index=True) if len(fresh) else kept
        fresh = fresh.sort_values(["t_us", "event_id"], ignore_index=True)
    if not len(fresh):
        return fresh
    ready = len(fresh) if closing else int(np.searchsorted(fresh["t_us"].to_numpy(), fresh["t_us"].iloc[-1] - delay_us, side="left"))
    waiting = fresh.iloc[ready:]
    if len(waiting):
        convert = {T.LongType(): int, T.DoubleType(): float, T.StringType(): str}
        held.update(tuple(
            [None if v is None or v != v else convert[f.dataType.elementType](v) for v in waiting[f.name]] for f in schema.fields))
    else:
        held.clear()
    return fresh.iloc[:ready].reset_index(drop=True)


def with_facts(events: DataFrame) -> DataFrame:
    """Client packets with the per-row facts of :data:`FLAGS` as whole numbers."""
    values = state._values()
    df = events
    if "payload" in df.columns:
        df = df.withColumn("payload_entropy", E.byte_entropy("payload")).drop("payload")
    elif "payload_entropy" not in df.columns:
        df = df.withColumn("payload_entropy", F.lit(0.0))
    mid = F.col("mid") if "mid" in df.columns else F.lit(None)
    return df.withColumn("mid", mid.cast("long")).select(
        "protocol", "source_id", *PASSED,
        F.nullif(D.resource("detail"), F.lit("")).alias("resource"),
        *[values[n].cast("long").alias(n) for n in FLAGS],
    )


def source_state_stream(events: DataFrame, delay_us: int = 0, closing: DataFrame | None = None) -> DataFrame:
    """Stream form of ``operators.state.source_state`` with a ``late`` flag.

    Rows wait ``delay_us`` of their source's event time for older ones.  A row of the stream ``closing`` (``protocol``,
    ``source_id``) releases what its source still holds.
    """
    rows = with_facts(events).withColumn("closing", F.lit(False))
    if closing is not None:
        zero = {T.LongType(): 0, T.DoubleType(): 0.0, T.StringType(): ""}
        rest = [F.lit(zero[_TYPES.get(n, T.LongType())]).cast(_TYPES.get(n, T.LongType())).alias(n) for n in _HELD]
        rows = rows.unionByName(closing.select("protocol", "source_id", *rest, F.lit(True).alias("closing")))
    return rows.groupBy("protocol", "source_id").transformWithStateInPandas(
        SourceWindows(delay_us), OUTPUT, outputMode="append", timeMode="none"
    )


def features_and_late(events: DataFrame, delay_us: int = 0, closing: DataFrame | None = None) -> DataFrame:
    """Client packets of a stream with all behavioral features and the flag ``late``; late rows have no features."""
    # Read from the text once; four features use it.
    rows = source_state_stream(events, delay_us, closing).withColumn("_resource", D.resource("detail"))
    cols = vectors.behavioral_columns(F.col("_resource"))
    return rows.select(
        "protocol", "source_id", *PASSED, "late", *[F.when(~F.col("late"), cols[f]).alias(f) for f in FEATURES]
    )


def behavioral_stream(events: DataFrame, delay_us: int = 0, closing: DataFrame | None = None) -> DataFrame:
    """Client packets of a stream with all behavioral features; late rows are left out (``features_and_late`` has them)."""
    return features_and_late(events, delay_us, closing).filter(~F.col("late")).drop("late")
