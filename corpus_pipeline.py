"""From documents to token digests: toxicity, quality rules, near copies, mixing, and BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  All but the last return rows with the
columns of their input; extra columns are carried along.  Null and empty texts fail the base quality rule.  Labels are read from ``sf_dir``.
An empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotlens.llm import bpe, jaccard, mixing, quality, toxicity
from iotlens.llm.common import id_share, stored, table, unused
from iotlens.llm.queries import TOXIC_FROM


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit; the model learns from labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").filter(id_share("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels)
    return docs.filter(toxicity.score(model, docs["text"]) < TOXIC_FROM)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cutoffs learned from labelled documents of this stage."""
    _, chosen = quality.fit(docs, table(spark, sf_dir, "labels"))
    helper = unused(docs, "_stats")
    return docs.withColumn(helper, quality.stats(docs["text"])).filter(quality.kept(F.col(helper), chosen)).drop(helper)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.materialise(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return docs.select("doc_id", bpe.digest(path, F.col("text")).alias("d")).select("doc_id", "d.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

# Trained models, exact binomial tests and BPE are beyond SQL: tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
