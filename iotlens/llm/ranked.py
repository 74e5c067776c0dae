"""Ranked lexical search, term at a time with a limited number of accumulators.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased.  All scores are integers:
the sum over an item's distinct terms of ``w * ((10^9 tf) div (1000 tf + 20 m))`` (see ``weight`` and ``norms``).

1. *Index.*  One pass over the documents keeps the postings of the items' terms, in blocks of about ``BLOCK_POSTS`` postings.  A block is
   one row of a stored table, sorted by term, so no list of a frequent term ever meets in one task.
2. *Statistics.*  Numbers of documents and terms and the document frequencies are sums over all blocks.
3. *First bound.*  Each item's rarest terms, until ``k`` documents hold one, give every document that holds them a partial score.
   The k-th best of these over all blocks, read from a histogram that adds up, is a lower bound of the item's k-th score.
4. *Terms at a time.*  In each block an item's terms run from rare to frequent.  As long as the terms left could lift an unseen
   document to the k-th partial score known, their postings create accumulators; after that they only update those that
   exist, exactly.  Limiting is a proof, not a cut: what gets no accumulator stays below k documents.
5. *Merge.*  A block gives at most ``k`` rows an item, those that reach the bound; two windows (by item and salt, then item) rank them.

The items are the stated query set: they run in groups of about ``GROUP_TERMS`` (item, term) pairs, which bounds what tasks and driver hold.
Rows of one item id are one item with the terms of all; a null item id is an item too.  Null texts and texts without a term hold nothing and
don't count.  Documents with a null id rank behind equal scores with one.  Rows that repeat are documents of their own.  Equal
scores go by ascending id.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iotlens.llm.common import stored

BLOCK_POSTS = 400_000
BLOCK_DOCS = 1 << 14
GROUP_TERMS = 200_000
SALTS = 64
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8")])
POSTING = np.dtype([("doc", "<i4"), ("tf", "<i4")])

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order; separators are ASCII, so they are found in UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def norms(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms; beyond 64 bits the products are taken as Python integers."""
    wide = 50 * documents * int(n.max(initial=0)) >= 1 << 63
    return (100 - 50 + (50 * documents * (n.astype(object) if wide else n)) // length).astype(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, found = [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            own = sorted(set(terms(text)))
            rows += [k] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())], ["item_id", "term"])


BLOCK = "n_docs long, n_terms long, docs binary, terms binary, counts binary, posts binary"


def _blocks(vocabulary: dict[bytes, int]):
    """Documents to packed blocks: documents that hold a term of the vocabulary, and postings by (term, document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int, int]] = []
        parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        n_docs = n_terms = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal n_docs, n_terms, held
            term = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
            post = np.zeros(len(term), POSTING)
            if parts:
                post["tf"] = np.concatenate([p[1] for p in parts])
                post["doc"] = np.repeat(np.array([p[2] for p in parts]), [len(p[0]) for p in parts])
            order = np.argsort(term, kind="stable")  # documents of a term stay in order
            used, counts = np.unique(term, return_counts=True)
            row = [n_docs, n_terms, np.array(docs, DOC).tobytes(), used.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), post[order].tobytes()]
            docs.clear(), parts.clear()
            n_docs = n_terms = held = 0
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["n_docs", "n_terms", "docs", "terms", "counts", "posts"])

        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                words = terms(text)
                if not words:
                    continue
                n_docs += 1
                n_terms += len(words)
                codes = np.fromiter((vocabulary.get(w, -1) for w in words), np.int32, len(words))
                own, tf = np.unique(codes[codes >= 0], return_counts=True)
                if not len(own):
                    continue
                doc_id = b.column(0)[k].as_py()
                parts.append((own, tf, len(docs)))
                docs.append((doc_id or 0, doc_id is None, len(words)))
                held += len(own)
                if held >= BLOCK_POSTS or len(docs) >= BLOCK_DOCS:
                    yield flush()
        if n_docs:
            yield flush()

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for used, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[np.frombuffer(used, "<i4")] += np.frombuffer(counts, "<i4")
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "df"])

    return run


class Lists:
    """A block's postings by term: documents, what the term adds to each, and the most it adds."""

    def __init__(self, docs: bytes, used: bytes, counts: bytes, posts: bytes, weights: np.ndarray, documents: int, length: int):
        self.docs = np.frombuffer(docs, DOC)
        used_terms, own = np.frombuffer(used, "<i4"), np.frombuffer(counts, "<i4")
        p = np.frombuffer(posts, POSTING)
        self.doc = p["doc"].astype(np.int64)
        tf = p["tf"].astype(np.int64)
        m = norms(self.docs["n"], documents, length)[self.doc]
        self.add = np.repeat(weights[used_terms], own) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        self.end = np.cumsum(own)
        self.at = {t: k for k, t in enumerate(used_terms.tolist())}
        self.most = np.maximum.reduceat(self.add, self.end - own) if len(p) else self.add

    def part(self, k: int) -> slice:
        return slice(int(self.end[k - 1]) if k else 0, int(self.end[k]))


def best(lists: Lists, order: list[int], least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers and exact scores of a block's ``k`` best documents for terms in ``order``, of at least ``least``."""
    present = [lists.at[t] for t in order if t in lists.at]
    left = np.cumsum(lists.most[present][::-1])[::-1]  # the most that this term and all later ones add
    acc = np.zeros(len(lists.docs), np.int64)
    survivors = None
    kth = least
    for place, t in enumerate(present):
        own = lists.part(t)
        doc, add = lists.doc[own], lists.add[own]
        if survivors is None and left[place] >= max(kth, 1):
            acc[doc] += add
            held = acc[acc > 0]
            if len(held) >= k:
                kth = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
            continue
        if survivors is None:
            survivors = np.flatnonzero(acc)
        if not len(survivors):
            break
        at = np.minimum(np.searchsorted(doc, survivors), len(doc) - 1)
        hit = doc[at] == survivors
        acc[survivors[hit]] += add[at[hit]]
    found = np.flatnonzero(acc >= max(least, 1))
    if len(found) > k:
        rank = np.lexsort((lists.docs["id"][found], lists.docs["null"][found], -acc[found]))
        found = found[rank[:k]]
    return found, acc[found]


def _bucket(score: np.ndarray) -> np.ndarray:
    """Eighths of a power of two."""
    return np.floor(8 * np.log2(score.astype(np.float64))).astype(np.int32)


def _each_block(weights: np.ndarray, documents: int, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
    for b in batches:
        for row in b.select(["docs", "terms", "counts", "posts"]).to_pylist():
            yield Lists(row["docs"], row["terms"], row["counts"], row["posts"], weights, documents, length)


def _first_scores(firsts: list[list[int]], weights: np.ndarray, documents: int, length: int):
    """Partial scores of each item's rarest terms, counted in buckets with the least score of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _each_block(weights, documents, length, batches):
            out: list[tuple[int, int, int, int]] = []
            for item, first in enumerate(firsts):
                own = [lists.part(lists.at[t]) for t in first if t in lists.at]
                if not own:
                    continue
                doc, back = np.unique(np.concatenate([lists.doc[s] for s in own]), return_inverse=True)
                score = np.zeros(len(doc), np.int64)
                np.add.at(score, back, np.concatenate([lists.add[s] for s in own]))
                score = np.sort(score[score > 0])
                bucket, start, counts = np.unique(_bucket(score), return_index=True, return_counts=True)
                out += zip([item] * len(bucket), bucket.tolist(), counts.tolist(), score[start].tolist())
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["item", "bucket", "n", "least"])

    return run


def _scores(orders: list[list[int]], least: list[int], weights: np.ndarray, documents: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _each_block(weights, documents, length, batches):
            items, ids, nulls, scores = [], [], [], []
            for item, order in enumerate(orders):
                found, score = best(lists, order, least[item], k)
                items.append(np.full(len(found), item, np.int32))
                ids.append(lists.docs["id"][found])
                nulls.append(lists.docs["null"][found])
                scores.append(score)
            if items:
                ids_or_null = pa.array(np.concatenate(ids), mask=np.concatenate(nulls).astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), ids_or_null, pa.array(np.concatenate(scores))], ["item", "doc_id", "score"])

    return run


def _group(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Ranked rows of one group of items."""
    spark = docs.sparkSession
    by_item: dict = {}
    for r in pairs.collect():  # about GROUP_TERMS rows
        by_item.setdefault(r["item_id"], []).append(bytes(r["term"]))
    names = list(by_item)
    vocabulary = {t: n for n, t in enumerate(sorted({t for own in by_item.values() for t in own}))}
    index = stored(docs.mapInArrow(_blocks(vocabulary), BLOCK), "ranked-index", group_bytes=8 << 20)
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    documents, length = int(totals[0] or 0), int(totals[1] or 1)
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "counts").mapInArrow(_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]  # one row a term of the group
    weights = np.array([weight(documents, d) if d else 0 for d in df.tolist()], np.int64)
    orders = [sorted((n for n in map(vocabulary.get, by_item[i]) if df[n]), key=lambda n: (df[n], n)) for i in names]
    firsts = []
    for order in orders:
        enough = int(np.searchsorted(np.cumsum(df[order]), k)) + 1 if order else 0
        firsts.append(order[:enough])
    buckets = index.mapInArrow(_first_scores(firsts, weights, documents, length), "item int, bucket int, n long, least long").groupBy("item", "bucket").agg(
        F.sum("n").alias("n"), F.min("least").alias("least")).collect()  # a few hundred buckets an item at most
    least, seen = [0] * len(names), [0] * len(names)
    for r in sorted(buckets, key=lambda r: -r["bucket"]):
        if seen[r["item"]] < k:
            seen[r["item"]] += r["n"]
            if seen[r["item"]] >= k:
                least[r["item"]] = r["least"]
    found = index.mapInArrow(_scores(orders, least, weights, documents, length, k), "item int, doc_id long, score long")
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*best_first)
    ranked = found.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best_first))).filter(F.col("rank") <= k)
    item_type = pairs.schema["item_id"].dataType.simpleString()
    named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {item_type}")
    return ranked.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents."""
    item_type = items.schema[item_id].dataType.simpleString()
    pairs = stored(items.select(item_id, item_text).mapInArrow(_item_terms, f"item_id {item_type}, term binary").distinct(), "ranked-items")
    groups = max(1, ceil(pairs.count() / GROUP_TERMS))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for g in range(groups):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else pairs
        part = _group(texts, own, k)
        out = part if out is None else out.unionByName(part)
    return out


def _sql() -> str:
    found = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {found} AS t FROM documents),
sized AS (SELECT r, doc_id, len(t) AS n, t FROM words WHERE len(t) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
asked AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, total GROUP BY term, nn),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weighed USING (term) JOIN sized USING (r), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


SQL = _sql()
