"""One query per operator over its whole table, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotlens.llm import bpe, extract, jaccard, language, minhash, mixing, quality, ranked, tokenfile, topk, toxicity, urls, whitening
from iotlens.llm.common import id_share, table

Query = Callable[[SparkSession, str], DataFrame]

TOXIC_FROM = 0.7


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(id_share("doc_id", 4) != 2))
    held_out = (id_share("doc_id", 4) == 2).alias("held_out")
    return docs.select("doc_id", held_out, language.predict(docs, model).alias("p")).select("doc_id", "held_out", "p.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(id_share("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", (id_share("doc_id", 3) == 1).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return docs.select("doc_id", bpe.digest(path, F.col("text")).alias("d")).select("doc_id", "d.*")


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = extract.extract(extract.fit(pages), F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, chosen = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    s = F.col("_stats")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counted.select(
        F.col("_id").alias("doc_id"), *(s[c].alias(c) for c in base),
        quality.base_failed(s).alias("base_failed"), quality.kept(s, chosen).alias("kept"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenfile.digests(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_urls": op3_urls,
    "op4_topk": op4_topk,
    "op5_bpe": op5_bpe,
    "op6_extract": op6_extract,
    "op7_jaccard": op7_jaccard,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_tokens": op10_tokens,
    "op11_ranked": op11_ranked,
    "op12_whitening": op12_whitening,
    "op13_minhash": op13_minhash,
}

SQL: dict[str, str] = {"op3_urls": urls.SQL, "op4_topk": topk.SQL, "op8_mixing": mixing.SQL, "op11_ranked": ranked.SQL}
