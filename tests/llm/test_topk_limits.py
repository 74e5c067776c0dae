"""Exact top-k search where integer products pass doubles, and where they pass a long."""

import pytest

from iotlens.llm import topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_products_beyond_doubles_are_exact(spark):
    big = float(1 << 26)
    rows = [(k, [big + k * 3 + 1, -big + k * 7, float(k % 5)]) for k in range(40)] + [(7, [big, big, 1.0]), (50, [big + 4, -big, 0.0])]
    vectors = frame(spark, rows)
    got = sorted(map(tuple, topk.search(vectors.filter("vec_id < 3"), vectors, k=5, scale=1).collect()))
    want = []
    for q, x in rows:
        if q < 3:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), v) for v, y in rows if v != q)
            want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:5])]
    assert got == sorted(want)


def test_products_beyond_a_long_raise(spark):
    vectors = frame(spark, [(1, [1e30, 1.0]), (2, [1.0, 2.0]), (100, [-1e30, 3.0])])
    with pytest.raises(Exception, match="beyond a long"):
        topk.search(vectors.filter("vec_id = 100"), vectors).collect()
