"""Shannon entropy, in two forms.

``text_entropy`` is a JVM expression for short strings (names, paths).
``byte_entropy`` counts the bytes of whole payload batches with one NumPy histogram per
Arrow batch; it sees every byte of every payload.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotlens.functions.numeric import _c, clamp01
from iotlens.settings import ENTROPY_CAP

_ROWS_PER_TABLE = 4096
_BYTES_PER_TABLE = 1 << 18


def _binary_views(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and flat bytes of a binary array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        col, width = col.cast(pa.binary()), np.int32
    _, offsets, data = col.buffers()
    starts = np.frombuffer(offsets, dtype=width)[col.offset : col.offset + len(col) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return starts.astype(np.int64), flat


def batch_entropy(col: pa.Array) -> np.ndarray:
    """Entropy in bits of each binary value of an Arrow array; nulls and empties are 0."""
    starts, flat = _binary_views(col)
    out = np.zeros(len(starts) - 1)
    lo = 0
    while lo < len(out):
        # A table covers few enough rows and bytes to stay at a few megabytes; a longer payload is counted in pieces.
        hi = int(np.searchsorted(starts, starts[lo] + _BYTES_PER_TABLE, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + _ROWS_PER_TABLE, len(out))
        lengths = np.diff(starts[lo : hi + 1])
        counts = np.zeros((hi - lo) * 256, dtype=np.int64)
        for at in range(int(starts[lo]), int(starts[hi]), _BYTES_PER_TABLE):
            end = min(at + _BYTES_PER_TABLE, int(starts[hi]))
            rows = np.searchsorted(starts[lo : hi + 1], np.arange(at, end, dtype=np.int32 if end < 1 << 31 else np.int64), side="right") - 1
            counts += np.bincount(rows * 256 + flat[at:end], minlength=(hi - lo) * 256)
        counts = counts.reshape(hi - lo, 256).astype(np.float64)
        logs = np.log2(counts, out=np.zeros_like(counts), where=counts > 0)
        weighted = (counts * logs).sum(axis=1)
        full = lengths > 0
        out[lo:hi][full] = np.log2(lengths[full]) - weighted[full] / lengths[full]
        lo = hi
    return np.maximum(out, 0.0)


@F.arrow_udf(T.DoubleType())
def _byte_entropy(col: pa.Array) -> pa.Array:
    return pa.array(batch_entropy(col))


def byte_entropy(payload) -> Column:
    """Bits per byte of a binary column."""
    return _byte_entropy(F.coalesce(_c(payload), F.lit(b"").cast("binary")))


def text_entropy(text) -> Column:
    """Bits per byte of a string column (bytes, not code points)."""

    def of(line: Column) -> Column:
        n = F.length(line).cast("double")

        def part(ch: Column) -> Column:
            count = (F.length(line) - F.length(F.replace(line, ch, F.lit("")))).cast("double")
            return count * F.log2(count)

        chars = F.array_distinct(F.split(line, ""))
        weighted = F.aggregate(chars, F.lit(0.0), lambda acc, ch: acc + F.when(ch == "", 0.0).otherwise(part(ch)))
        return F.when(n <= 1, F.lit(0.0)).otherwise(F.greatest(F.log2(n) - weighted / n, F.lit(0.0)))

    # Bound as a lambda variable, the text is computed once and not once per character.
    one_per_byte = F.decode(F.coalesce(_c(text), F.lit("")).cast("binary"), "ISO-8859-1")
    return F.get(F.transform(F.array(one_per_byte), of), F.lit(0))


def text_entropy_unit(text) -> Column:
    """Text entropy as a share of 4 bits."""
    return clamp01(text_entropy(text) / ENTROPY_CAP)
