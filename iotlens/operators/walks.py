"""Byte walks of unknown length over whole Arrow batches.

Every helper steps all packets of a batch together: the loop runs over the n-th frame,
filter or option, never over packets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotlens.functions.entropy import _binary_views

WALK = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("observe", T.BooleanType()),
        T.StructField("blockwise", T.BooleanType()),
        T.StructField("options", T.IntegerType()),
        T.StructField("malformed", T.BooleanType()),
    ]
)

# Option numbers with a meaning of their own.
OBSERVE_OPTION, PATH_OPTION, BLOCK_OPTIONS = 6, 11, (23, 27)


class _Packets:
    """Random access to the bytes of all packets of a batch; bytes past an end read as 0."""

    def __init__(self, col: pa.Array):
        starts, self.flat = _binary_views(col)
        self.start, self.length = starts[:-1], np.diff(starts)
        if len(self.flat) == 0:
            self.flat = np.zeros(1, dtype=np.uint8)

    def at(self, rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
        inside = offset < self.length[rows]
        where = np.where(inside, self.start[rows] + offset, 0)
        return np.where(inside, self.flat[where], 0).astype(np.int64)


def frame_ends(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, end offset) of every complete MQTT frame, in order within a row."""
    p = _Packets(col)
    rows = np.arange(len(p.length))
    pos = np.zeros(len(rows), dtype=np.int64)
    found_rows, found_ends = [], []
    while True:
        go = pos + 2 <= p.length[rows]
        rows, pos = rows[go], pos[go]
        if len(rows) == 0:
            break
        used = np.zeros(len(rows), dtype=np.int64)
        remaining = np.zeros(len(rows), dtype=np.int64)
        reading = np.ones(len(rows), dtype=bool)
        overlong = np.zeros(len(rows), dtype=bool)
        for step in range(4):
            reading &= pos + 1 + used < p.length[rows]
            byte = p.at(rows, pos + 1 + used)
            remaining += np.where(reading, (byte & 0x7F) << (7 * step), 0)
            used += reading
            more = reading & (byte >= 0x80)
            if step == 3:
                overlong = more
            reading = more
        end = pos + 1 + used + remaining
        whole = ~overlong & (end <= p.length[rows])
        rows, pos = rows[whole], end[whole]
        found_rows.append(rows)
        found_ends.append(pos)
    if not found_rows:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    all_rows, all_ends = np.concatenate(found_rows), np.concatenate(found_ends)
    order = np.lexsort((all_ends, all_rows))
    return all_rows[order], all_ends[order]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def mqtt_frame_ends(col: pa.Array) -> pa.Array:
    rows, ends = frame_ends(col)
    counts = np.bincount(rows, minlength=len(col))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ends.astype(np.int32)))


def filter_wildcards(col: pa.Array) -> np.ndarray:
    """True where any topic filter of a SUBSCRIBE body (after the packet id) holds ``#`` or ``+``.

    ``col`` holds the packet from its first filter on; a truncated list gives False.
    """
    p = _Packets(col)
    marks = np.concatenate([[0], np.cumsum((p.flat == ord("#")) | (p.flat == ord("+")))])
    hit = np.zeros(len(p.length), dtype=bool)
    rows = np.arange(len(p.length))
    pos = np.zeros(len(rows), dtype=np.int64)
    while True:
        go = pos + 2 <= p.length[rows]
        rows, pos = rows[go], pos[go]
        if len(rows) == 0:
            return hit
        size = (p.at(rows, pos) << 8) | p.at(rows, pos + 1)
        first, last = pos + 2, pos + 2 + size
        whole = last <= p.length[rows]
        rows, first, last = rows[whole], first[whole], last[whole]
        found = marks[p.start[rows] + last] > marks[p.start[rows] + first]
        hit[rows[found]] = True
        rows, pos = rows[~found], last[~found] + 1


@F.arrow_udf(T.BooleanType())
def mqtt_filters_wild(col: pa.Array) -> pa.Array:
    return pa.array(filter_wildcards(col))


def option_walk(col: pa.Array) -> pa.StructArray:
    """Walks CoAP options of packets given from their first option on."""
    p = _Packets(col)
    n = len(p.length)
    number, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    observe, block, bad, has_path = (np.zeros(n, dtype=bool) for _ in range(4))
    seg_rows, seg_starts, seg_sizes = [], [], []
    rows, pos = np.arange(n), np.zeros(n, dtype=np.int64)

    def extended(rows, pos, nibble):
        length = p.length[rows]
        one, two = nibble == 13, nibble == 14
        ok = ~((nibble == 15) | (one & (pos >= length)) | (two & (pos + 1 >= length)))
        b0, b1 = p.at(rows, pos), p.at(rows, pos + 1)
        value = np.where(one, b0 + 13, np.where(two, ((b0 << 8) | b1) + 269, nibble))
        return value, pos + one + 2 * two, ok

    while True:
        go = (pos < p.length[rows]) & (p.at(rows, pos) != 0xFF)
        rows, pos = rows[go], pos[go]
        if len(rows) == 0:
            break
        head = p.at(rows, pos)
        delta, pos, ok = extended(rows, pos + 1, head >> 4)
        size, pos, ok2 = extended(rows, pos, head & 0x0F)
        ok &= ok2
        bad[rows[~ok]] = True
        rows, pos, delta, size = rows[ok], pos[ok], delta[ok], size[ok]
        # Option numbers are unsigned 32-bit sums.
        number[rows] = (number[rows] + delta) & 0xFFFFFFFF
        count[rows] += 1
        fits = pos + size <= p.length[rows]
        bad[rows[~fits]] = True
        rows, pos, size = rows[fits], pos[fits], size[fits]
        num = number[rows]
        observe[rows] |= num == OBSERVE_OPTION
        block[rows] |= np.isin(num, BLOCK_OPTIONS)
        seg = (num == PATH_OPTION) & (has_path[rows] | (size > 0))
        seg_rows.append(rows[seg])
        seg_starts.append(p.start[rows[seg]] + pos[seg])
        seg_sizes.append(size[seg])
        has_path[rows[seg]] = True
        pos = pos + size

    paths = _joined(n, p.flat, seg_rows, seg_starts, seg_sizes)
    return pa.StructArray.from_arrays(
        [paths, pa.array(observe), pa.array(block), pa.array(count.astype(np.int32)), pa.array(bad)],
        names=[f.name for f in WALK],
    )


def _joined(n, flat, seg_rows, seg_starts, seg_sizes) -> pa.Array:
    """Path segments of each row joined by ``/`` (no segments give an empty path)."""
    rows = np.concatenate(seg_rows) if seg_rows else np.zeros(0, dtype=np.int64)
    if len(rows) == 0:
        return pa.array([""] * n, pa.string())
    starts, sizes = np.concatenate(seg_starts), np.concatenate(seg_sizes)
    order = np.argsort(rows, kind="stable")
    rows, starts, sizes = rows[order], starts[order], sizes[order]
    ends = np.cumsum(sizes)
    inner = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    data = flat[np.repeat(starts, sizes) + inner]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pieces), b"/")
    return _readable(joined)


def _readable(paths: pa.Array) -> pa.Array:
    try:
        return paths.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in paths.to_pylist()], pa.string())


@F.arrow_udf(WALK)
def coap_options(col: pa.Array) -> pa.Array:
    return option_walk(col)
