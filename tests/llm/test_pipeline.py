"""Stages keep the columns of their input and what they decide takes effect."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from iotlens.llm import mixing, quality, toxicity
from iotlens.llm.common import id_share, stored, table
from iotlens.llm.queries import TOXIC_FROM
from test_jaccard import brute


def test_stages(spark, medium):
    docs = table(spark, medium, "documents")
    for c in ("score", "_digest", "_n", "_source", "_Mix", "_mix_n", "_near", "_NEAR_hash", "_row_hash", "_stats", "_stats_", "class", "size", "taken"):
        docs = docs.withColumn(c, F.lit(1))  # names that stages use for helper columns or results
    start, columns = docs.count(), docs.columns
    sizes = []
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, medium), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert start > sizes[0] > sizes[1] > sizes[2] > 0 and sizes[3] > sizes[2]
    assert cp.STAGES[-1][1](spark, docs, medium).count() == sizes[3]


def test_empty_table(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_stages_keep_the_rows_of_plain_python(spark, medium):
    """The model is taken as given; sf0.01 has too few labels for cutoffs, so quality is the base rule."""
    docs = table(spark, medium, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}

    def ids(df):
        return sorted(r[0] for r in df.select("doc_id").collect())

    model = toxicity.fit(docs, table(spark, medium, "labels").filter(id_share("doc_id", 3) != 1))
    assert ids(cp.drop_toxic(spark, docs, medium)) == sorted(i for i, t in texts.items() if model.score(t) < TOXIC_FROM)

    def base(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = Counter(windows)
        repeated = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(5)}
        return len(w) >= 10 and 100 * len(repeated) <= 20 * len(w)

    assert not quality.fit(docs, table(spark, medium, "labels"))[1]
    assert ids(cp.keep_quality(spark, docs, medium)) == sorted(i for i, t in texts.items() if base(t))
    first = {group for _, size, group in brute(list(texts.items())) if size} | {i for i, size, _ in brute(list(texts.items())) if not size}
    assert ids(cp.drop_near_copies(spark, docs, medium)) == sorted(first)
    want = Counter()
    for r in mixing.plan(docs).collect():
        if r["size"]:
            repeats, rest = divmod(r["taken"], r["size"])
            want[r["doc_id"]] += repeats + (2 * rest >= r["size"])
    assert Counter(ids(cp.mix_sources(spark, docs, medium))) == +want
