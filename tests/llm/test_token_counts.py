"""The packing pass of token files counts its ids, and holds them in two bytes where it can."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from iotlens.llm import tokenfile


def test_counts_of_blocks_add_up():
    assert [tokenfile._width(n) for n in (49_152, 1 << 16, (1 << 16) + 1)] == ["<u2", "<u2", "<u4"]
    whole = pa.list_(pa.int32())
    blocks = pa.RecordBatch.from_arrays([pa.array([[1, 4], [4], []], whole), pa.array([[5, 2], [7], []], whole)], ["used", "counts"])
    (out,) = tokenfile._count(6)(iter([blocks, blocks]))
    assert out.to_pydict() == {"id": [1, 4], "n": [10, 18]}
