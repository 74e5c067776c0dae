"""Quality rules with risk-controlled thresholds.

Each rule compares one share of a text with a cutoff.  Cutoffs come from labelled rows: in every stratum (text
length) each rule tests a fixed grid from the loosest cutoff to the tightest.  A cutoff passes while the exact
binomial tail shows that the rule rejects at most ``risk / rules`` of good texts; the first failure ends the
test, so cutoffs of one rule need no further correction, and the level ``alpha`` is divided by strata times
rules (Bonferroni).  With probability ``1 - alpha`` no stratum loses more than ``risk`` of its good texts.

The grid is fixed beforehand and nothing is fitted, so every labelled row is a valid holdout.  Counts cover
all labelled rows.  Null and empty texts have zero words and fail the base rule.  A stratum with too few
labelled good rows gets no cutoff: only the base rule applies there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotlens.llm.bpe import slices
from iotlens.llm.common import hashed_words, mix, stored, window_hashes

WINDOW = 5
STATS = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")])

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")

GRID = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
STRATA = (100, 1000)


def repeated_words(hashed: np.ndarray, lens: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text: words inside windows of ``width`` words that occur twice or more in that text."""
    n = len(hashed)
    if n < width:
        return np.zeros(len(lens), np.int64)
    owner = np.repeat(np.arange(len(lens)), lens)
    inside = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    keys = window_hashes(hashed, width)[inside]
    keys = mix(keys ^ mix(owner[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, inside[again], 1)
    np.add.at(edges, inside[again] + width, -1)
    return np.bincount(owner, np.cumsum(edges[:-1]) > 0, minlength=len(lens)).astype(np.int64)


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    return len(lines), len(lines) - len(set(lines))


def text_stats(texts: list[str | None]) -> pd.DataFrame:
    known = [t or "" for t in texts]
    hashed, lens = hashed_words(known, lower=False)
    repeats = repeated_words(hashed, lens)
    rows = []
    for t, n, rep in zip(known, lens.tolist(), repeats.tolist()):
        raw = t.encode("utf-8", "replace")
        count = lambda chars: len(raw) - len(raw.translate(None, chars))  # noqa: B023, E731
        lines, dups = dup_lines(t)
        rows.append((n, len(t) - count(_SPACE), count(SYMBOLS), dups, rep, lines, count(_UPPER), raw.count(b"!")))
    return pd.DataFrame(rows, columns=STATS.names)


def stats(text: Column) -> Column:
    """Counts of each whole text as a struct of ``STATS``."""

    @F.pandas_udf(STATS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([text_stats(part) for part in slices(batch)] or [text_stats([])], ignore_index=True)

    return run(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def rules(s: Column) -> dict[str, Column]:
    """The share that each rule compares with its cutoff."""
    per = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))
    return {
        "symbols": per("n_symbols", "word_chars"),
        "shouting": per("n_upper", "word_chars"),
        "exclaims": per("n_exclaims", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
    }


def stratum(s: Column) -> Column:
    return reduce(lambda rest, k: F.when(s["n_words"] < STRATA[k], k).otherwise(rest), reversed(range(len(STRATA))), F.lit(len(STRATA)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, exactly."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(good: int, rejected: list[int], caught: list[int], risk: float, level: float) -> float | None:
    """Tightest cutoff of ``GRID`` reached by the fixed sequence of tests; None if none is shown safe or none catches anything."""
    best = None
    for cutoff, bad in zip(GRID, rejected):
        if not good or bad > risk * good or binomial_tail(bad, good, risk) > level:
            break
        best = cutoff
    return best if best is not None and caught[GRID.index(best)] else None


def cutoffs(labelled: DataFrame, stats_col: str, quality: str, risk: float = 0.05, alpha: float = 0.05) -> dict[tuple[int, str], float]:
    """Cutoff per (stratum, rule) from all rows with a 0/1 ``quality`` that pass the base rule."""
    s = F.col(stats_col)
    shares = rules(s)
    known = labelled.filter(F.col(quality).isin(0, 1) & ~base_failed(s)).withColumn("_stratum", stratum(s))
    sums = [F.sum((share > c).cast("long")).alias(f"{name}_{k}") for name, share in shares.items() for k, c in enumerate(GRID)]
    seen = {(r["_stratum"], r[quality]): r for r in known.groupBy("_stratum", quality).agg(F.count("*").alias("n"), *sums).collect()}
    level = alpha / (len(shares) * (len(STRATA) + 1))
    out = {}
    for st in range(len(STRATA) + 1):
        good, bad = seen.get((st, 1)), seen.get((st, 0))
        for name in shares if good and bad else ():
            got = choose(good["n"], *([r[f"{name}_{k}"] for k in range(len(GRID))] for r in (good, bad)), risk / len(shares), level)
            if got is not None:
                out[st, name] = got
    return out


def kept(s: Column, chosen: dict[tuple[int, str], float]) -> Column:
    """False where the base rule or a cutoff of the text's stratum rejects."""
    over = [(stratum(s) == st) & (rules(s)[name] > c) for (st, name), c in chosen.items()]
    return ~reduce(lambda a, b: a | b, over, base_failed(s))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[DataFrame, dict[tuple[int, str], float]]:
    """The counts of every document (``_id``, ``_stats``), stored, and the cutoffs learned from the labelled ones.

    Only ids and counts are joined to the labels, never texts.
    """
    counted = stored(docs.select(F.col(doc_id).alias("_id"), stats(F.col(text)).alias("_stats")), "quality-stats")
    known = counted.join(labels.select(F.col(doc_id).alias("_id"), F.col(quality).cast("int").alias("_quality")), "_id")
    return counted, cutoffs(known, "_stats", "_quality")
