"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources in code-point order (null last) take the weights in turn.  The mix is ``total`` times all words.  A source
gets words by weight, at most ``cap`` times its own; what is above is shared again by weight among the others.
The level of the water is found from running sums over sources in order of cap by weight, so no loop is needed.

Within a source, documents are dealt to buckets of about ``per_bucket`` documents by a seeded digest of the id.  In each
bucket every document is taken the whole number of times; the fractional repetition takes whole documents in seeded order
until the bucket's share is used up, and part of the one document in which it ends.  A source's taken words
differ from its target by at most half a word per bucket.

Null texts and texts without words have size 0 and are taken 0 times.  Null sources are one source.  Null ids
share one digest.  Rows with equal ids are separate documents.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotlens.llm.common import WORD_PATTERN, small, unused

SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def digest(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))


def bucket(digested: Column, buckets: Column) -> Column:
    return F.conv(F.substring(digested, 1, 8), 16, 10).cast("long") % buckets


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, per_bucket: int = 2000) -> DataFrame:
    """One row per source of ``sized`` (``source``, ``size``): its words, target, whole repetitions, and buckets."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * float(total) - F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * float(cap)) / F.sum("weight").over(onward)
    filled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order)).withColumn(
        "capped", F.col("level") >= F.col("most") / F.col("weight"))
    water = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("place"))).over(whole)
    target = F.when(F.col("capped"), F.col("most")).otherwise(water * F.col("weight"))
    return filled.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("repeats"),
        F.greatest(F.ceil(F.col("n") / per_bucket), F.lit(1)).cast("long").alias("buckets"),
    )


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **settings) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, repeats, bucket, digest, taken``."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    goals = targets(sized, **settings).withColumnRenamed("source", "_source")
    joined = sized.join(goals, sized["source"].eqNullSafe(goals["_source"])).drop("_source")
    dealt = joined.withColumn("digest", digest(F.col("doc_id"), seed)).withColumn("bucket", bucket(F.col("digest"), F.col("buckets")))
    own = Window.partitionBy("source", "bucket")
    order = own.orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    more = F.col("target") - F.col("repeats") * F.col("source_size")
    share = F.floor(F.when(F.col("source_size") > 0, more * F.sum("size").over(own) / F.col("source_size")).otherwise(0) + 0.5)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), share - (F.sum("size").over(order) - F.col("size"))))
    return dealt.withColumn("taken", (F.col("repeats") * F.col("size") + extra).cast("long"))


def materialise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; a part of a document counts as whole from one half on.

    Only one digest per bucket, up to which documents get one more repetition, meets the texts; they aren't shuffled by id.
    """
    h = unused(docs, "_mix")  # no helper column clashes with a column of docs
    planned = plan(docs, doc_id, text, source, seed, **settings)
    once_more = 2 * (F.col("taken") - F.col("repeats") * F.col("size")) >= F.col("size")
    limits = small(planned.groupBy(F.col("source").alias(f"{h}_source"), F.col("bucket").alias(f"{h}_bucket")).agg(
        F.max(F.when(once_more & (F.col("size") > 0), F.col("digest"))).alias(f"{h}_limit"),
        F.first("repeats").alias(f"{h}_repeats"), F.first("buckets").alias(f"{h}_buckets")), "mix-limits")
    sources = small(limits.groupBy(F.col(f"{h}_source").alias(f"{h}_own")).agg(F.first(f"{h}_buckets").alias(f"{h}_n")), "mix-sources")
    counted = docs.join(sources, docs[source].eqNullSafe(F.col(f"{h}_own"))).withColumn(f"{h}_digest", digest(docs[doc_id], seed))
    counted = counted.withColumn(f"{h}_place", bucket(F.col(f"{h}_digest"), F.col(f"{h}_n")))
    joined = counted.join(limits, docs[source].eqNullSafe(F.col(f"{h}_source")) & (F.col(f"{h}_place") == F.col(f"{h}_bucket")))
    times = F.when(size_of(docs[text]) > 0, F.col(f"{h}_repeats") + F.coalesce((F.col(f"{h}_digest") <= F.col(f"{h}_limit")).cast("long"), F.lit(0))).otherwise(0)
    copies = joined.withColumn(f"{h}_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return copies.select(*(docs[c] for c in docs.columns))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS most FROM by_source),
levelled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0)::DOUBLE * 2.0::DOUBLE) / (sum(weight) OVER onward)::DOUBLE AS level,
    row_number() OVER (ORDER BY most / weight, source ASC NULLS LAST) AS place
  FROM ranked WINDOW
    before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    onward AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goals AS (
  SELECT source, source_size, n,
    CASE WHEN level >= most / weight THEN most ELSE weight * (SELECT arg_min(level, place) FROM levelled WHERE level < most / weight) END AS target
  FROM levelled),
dealt AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS repeats,
    md5(coalesce(s.doc_id::VARCHAR, 'null') || ':mix-1') AS digest, greatest(ceil(g.n / 2000.0), 1)::BIGINT AS buckets
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
placed AS (SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT % buckets AS bucket FROM dealt),
shared AS (
  SELECT *, sum(size) OVER (PARTITION BY source, bucket ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS earlier,
    floor(CASE WHEN source_size > 0 THEN (target - repeats * source_size) * (sum(size) OVER (PARTITION BY source, bucket))::DOUBLE / source_size ELSE 0 END + 0.5) AS share
  FROM placed)
SELECT doc_id, size, source_size, target, (repeats * size + greatest(0, least(size, share - earlier)))::BIGINT AS taken FROM shared
"""
