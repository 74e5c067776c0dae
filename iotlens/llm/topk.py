"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors become integers ``floor(scale * x)``.  A block of vectors is indexed by dimension and quantised impact: the power of
two of a component's size.  Postings of one impact level form its segments, highest level first.  For a block of queries
the segments are processed level by level: partial scores of all query-vector pairs grow, and what the unseen levels can still
add is at most ``|q| * |rest of v|`` (Cauchy-Schwarz on what is left).  The k-th best lower bound so far is a proof
for everything whose upper bound lies below it; when few pairs are left, or no level, the rest are scored exactly
from the whole integer vectors.  Nothing is decided by estimates.

Query and vector blocks meet by an equality join on block numbers: vectors are sent once per query block and queries once per
vector group, the cost of a blocked nested loop over a stated query set.  Each pair of blocks gives at most k rows per
query, and a windowed rank keeps the best.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids.  Vectors of different lengths are
compared on their common components, the rest being zero.  Ties go to the smaller id; repeated ids are separate rows.  A
query doesn't meet rows of its own id.  Scores are exact: where the largest components, multiplied and summed over all dimensions, leave
a long (from 2^63 on), the search raises ``OverflowError`` and gives no wrapped ranks.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP_ROWS = 2048
QUERY_ROWS = 2048
EXACT = float(1 << 53)
LONGEST = float(1 << 63)


def integers(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``id, v`` with integer components, without vectors that take no part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & sound).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer rows."""
    return np.einsum("ij,ij->i", q, v)


class Index:
    """Impact-ordered segments of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        size = np.abs(vectors)
        level = np.where(size > 0, np.frexp(size.astype(float))[1], 0)
        self.levels = sorted(set(np.unique(level).tolist()) - {0}, reverse=True)
        # Dense per level: most segments of embeddings are well filled.
        self.segments = {e: np.where(level == e, vectors, 0).astype(float) for e in self.levels}
        rest = (vectors.astype(float) ** 2).sum(1)
        self.rest: list[np.ndarray] = []
        for e in self.levels:
            rest = rest - (self.segments[e] ** 2).sum(1)
            self.rest.append(np.sqrt(np.maximum(rest, 0)))

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, few: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of query and vector, and scores, of each query's best k; ``own`` are the queries' ids."""
        q = queries.astype(float)
        norm = np.sqrt((q**2).sum(1))
        partial = np.zeros((len(q), len(ids)))
        alive = own[:, None] != ids[None, :]
        slack = 1e-6 * (1 + norm[:, None] * np.sqrt((self.vectors.astype(float) ** 2).sum(1))[None, :])
        for step, e in enumerate(self.levels):
            partial += q @ self.segments[e].T
            open_part = norm[:, None] * self.rest[step][None, :] + slack
            lower = np.where(alive, partial - open_part, -np.inf)
            if lower.shape[1] > k:
                bound = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k]
                alive &= partial + open_part >= bound[:, None]  # proof: all others have k better ones
            if alive.sum() <= few * alive.size + k * len(q):
                break
        at_q, at_v = np.nonzero(alive)
        scores = _exact(queries[at_q], self.vectors[at_v])
        order = np.lexsort((ids[at_v], -scores, at_q))
        at_q, at_v, scores = at_q[order], at_v[order], scores[order]
        place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
        best = place < k
        return at_q[best], at_v[best], scores[best]


def _all_scored(q: np.ndarray, v: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``Index.search`` beyond exact doubles: each query in turn meets all vectors in whole numbers."""
    at_q, at_v, best = [], [], []
    for i in range(len(q)):
        scores = v @ q[i]
        others = np.flatnonzero(ids != own[i])
        first = others[np.lexsort((ids[others], -scores[others]))[:k]]
        at_q.append(np.full(len(first), i)), at_v.append(first), best.append(scores[first])
    return np.concatenate(at_q), np.concatenate(at_v), np.concatenate(best)


def _meet(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(queries["v"].map(len).max(), vectors["v"].map(len).max())
        q, v = _matrix(queries["v"], width), _matrix(vectors["v"], width)
        own, ids = queries["id"].to_numpy(), vectors["id"].to_numpy()
        largest = float(np.abs(q).max()) * float(np.abs(v).max()) * width
        if largest < EXACT:
            a, b, scores = Index(v).search(q, own, ids, k)
        elif largest < LONGEST:
            a, b, scores = _all_scored(q, v, own, ids, k)
        else:
            raise OverflowError(f"inner products of these vectors may reach {largest:.3g}, beyond a long")
        return pd.DataFrame({"query_id": own[a], "vec_id": ids[b], "score": scores})

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products."""
    q, v = integers(queries, vec_id, vector, scale), integers(vectors, vec_id, vector, scale)
    n_q, n_v = q.count(), v.count()
    q_blocks, groups = max(1, ceil(n_q / QUERY_ROWS)), max(1, ceil(n_v / GROUP_ROWS))
    place = F.xxhash64("id", "v")
    q = q.withColumn("q_block", F.pmod(place, F.lit(q_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    v = v.withColumn("part", F.pmod(place, F.lit(groups)).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    met = q.groupBy("part", "q_block").cogroup(v.groupBy("part", "q_block")).applyInPandas(_meet(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
