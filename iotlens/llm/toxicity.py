"""Toxicity by weak supervision.

1. *Voters.*  Words, and word beginnings met once, twice or three times, that mark toxic texts are counted over a bounded
   sample of labelled rows; a greedy cover picks the lexicon voters.  Pattern voters (shouting, symbols, repetition) join them.
2. *Label model.*  A generative two-class model explains the votes: how many a text draws, which voters cast them, and how far
   voters agree beyond their class.  EM estimates the voters' rates in either class, their residual correlations and the class
   posterior of each row.  The given label starts EM and is one more voter of limited trust, so clear votes overrule it.
   Correlated voters share their evidence.
3. *Classifier.*  Logistic regression on the votes, fitted to the posterior labels.

Voters see windows of ``WINDOW`` to twice as many words, so a text's length alone brings no votes: fitting counts each window of a
labelled text as a row, and a text's score stands on its vote shares, that is, in how many of its windows a voter votes.

Fitting reads at most about ``rows_per_class`` rows of each label and as many windows; scoring reads every whole text.  Null and
empty texts get the score of a text without votes.  Without labelled rows of both kinds the score is the
share of toxic labels (0 without any).  Rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.llm.common import sample_by_count, stored

_WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
TIMES = (1, 2, 3)
WINDOW = 500
MOST_VOTES = 20
PATTERNS = ("shouting", "exclaims", "symbols", "repeats")


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    beginnings: dict[tuple[str, int], int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    bias: float = -30.0
    accuracies: list[tuple[str, float, float]] = field(default_factory=list)
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def votes(self, text: str | None) -> list[int]:
        """Numbers of the voters that vote for toxic; pattern voters come first."""
        if not text:
            return []
        words = Counter(_WORDS.findall(text.lower()))
        found = set(patterns(text)) | {self.words[w] for w in self.words.keys() & words.keys()}
        shortest = min(BEGINNINGS)
        starts = {b[:shortest] for b, _ in self.beginnings}
        near = Counter({w: c for w, c in words.items() if w[:shortest] in starts})
        return sorted(found | {self.beginnings[e] for e in beginnings(near) if e in self.beginnings})

    def score(self, text: str | None) -> float:
        parts = windows(text)
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[self.votes(t)].sum() for t in parts) / len(parts)))))


def windows(text: str | None) -> list[str]:
    """The text cut before words into parts of about equally many words, ``WINDOW`` or more if it has so many."""
    if not text or len(text) < 4 * WINDOW - 1:  # fewer than two windows of one-letter words
        return [text or ""]
    starts = [m.start() for m in _WORDS.finditer(text)]
    n = max(1, len(starts) // WINDOW)
    cuts = [0, *(starts[k * len(starts) // n] for k in range(1, n)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def patterns(text: str) -> list[int]:
    """Pattern voters of a text, by number in ``PATTERNS``."""
    n = len(text)
    upper = len(re.findall(r"[A-Z]", text))
    lines = text.split()
    return [k for k, yes in enumerate((
        upper > 0.5 * n,
        text.count("!") > 0.05 * n,
        sum(map(text.count, "#*$%&|<>")) > 0.05 * n,
        len(lines) >= 20 and len(set(lines)) < 0.3 * len(lines),
    )) if yes]


def beginnings(words: Counter) -> list[tuple[str, int]]:
    """Beginnings of the words, with how often at least words begin so."""
    counts = Counter()
    for n in BEGINNINGS:
        for w, c in words.items():
            if len(w) >= n:
                counts[w[:n]] += c
    return [(b, k) for b, c in counts.items() for k in TIMES if k <= c]


def entries(text: str | None) -> set[str]:
    """Words of a text; beginnings are written ``begin*1``, the number being how often at least."""
    words = Counter(_WORDS.findall(text.lower())) if text else Counter()
    return {*words, *(f"{b}*{k}" for b, k in beginnings(words))}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def out() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        rows = [keys, [toxic[k] for k in keys], [clean[k] for k in keys]]
        toxic.clear()
        clean.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64()))], ["entry", "toxic", "clean"])

    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            (toxic if label else clean).update(entries(text))
            if len(toxic) + len(clean) > 1_000_000:
                yield out()
    yield out()


def _cover(present: np.ndarray, label: np.ndarray, limit: int, least: int, cost: float = 4.0) -> list[int]:
    """Greedy choice of entries that reach toxic rows no earlier choice reaches; a clean row counts against them ``cost`` times."""
    open_rows, chosen = np.ones(len(label), bool), []
    while len(chosen) < limit:
        new = present[open_rows & label].sum(0)
        wrong = present[~label].sum(0)
        gain = np.where(present[label].sum(0) >= least, new - cost * wrong, -1)
        best = int(np.argmax(gain))
        if gain[best] < 1:
            break
        chosen.append(best)
        open_rows &= ~present[:, best]
    worth = present[label].sum(0) - cost * present[~label].sum(0)
    for k in map(int, np.argsort(-worth, kind="stable")):
        if len(chosen) >= limit or worth[k] <= 0:
            break
        # A beginning that votes as a chosen entry does adds nothing.
        both = present[:, chosen].T @ present[:, k].astype(float) if chosen else np.zeros(0)
        if not (both > 0.8 * present[:, [*chosen, k]].sum(0)[:-1]).any() or not chosen:
            chosen.append(k)
    return chosen


def label_model(votes: np.ndarray, label: np.ndarray, trust: float = 0.8, cut: float = 0.2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, rates per class (voters and then the label, x 2), residual correlations, and shares of evidence.

    A text of either class draws how many independent votes it gets, and then which voters cast them; a voter that stays silent
    says nothing by itself.  What two voters' votes have in common beyond their class is a residual correlation; above
    ``cut`` it is shared evidence, and each voter's vote counts ``1 / (1 + sum of its correlations beyond the cut)``.
    The given label starts EM and so tells the classes apart; after that it is a voter whose accuracy counts as at most
    ``trust`` (0.8: log odds of 1.4), so clear votes overrule it.
    """
    v, n = votes.astype(float), max(1, len(votes))
    given = label.astype(bool)
    post = np.where(given, 0.95, 0.05)
    for _ in range(rounds):
        classes = (1 - post, post)
        mass = np.array([m.sum() for m in classes])
        rate = np.column_stack([(m @ v + 0.05) / (m.sum() + 0.1) for m in classes])
        rest = v - np.outer(classes[0], rate[:, 0]) - np.outer(classes[1], rate[:, 1])
        cov = rest.T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.maximum(corr - cut, 0).sum(1))
        many = np.minimum(np.round(v @ share), MOST_VOTES).astype(int)
        drawn = np.column_stack([(np.bincount(many, m, MOST_VOTES + 1) + 0.5) / (m.sum() + 0.5 * (MOST_VOTES + 1)) for m in classes])
        picked = rate / (share @ rate)
        marked = np.array([(m @ given + 0.05) / (m.sum() + 0.1) for m in classes])
        held = np.clip(marked, [1 - trust, 1 - trust], [trust, trust])
        logit = np.log((mass[1] + 0.05) / (mass[0] + 0.05)) + v @ (share * np.log(picked[:, 1] / picked[:, 0]))
        logit += np.log(drawn[:, 1] / drawn[:, 0])[many]
        logit += np.where(given, np.log(held[1] / held[0]), np.log((1 - held[1]) / (1 - held[0])))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-6:
            break
    return post, np.vstack([rate, marked]), corr, share


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.03, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (target - p) - penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), grad)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 10_000, candidates: int = 600, voters: int = 100,
        doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learns from ``labels`` (``doc_id``, ``toxic`` 0/1; other values count as unlabelled) joined to their texts."""
    lab = labels.select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("_toxic")).filter(F.col("_toxic").isin(0, 1))
    lab = sample_by_count(lab, "_toxic", rows_per_class, F.col("_id"))
    # About 2 * rows_per_class ids and flags: a bounded broadcast.
    known = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(lab), "_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = windows(text)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array([label] * len(parts), pa.int32())], ["_text", "_toxic"])

    known = known.select("_text", "_toxic").filter(F.length("_text") > 0).mapInArrow(cut, "_text string, _toxic int")
    known = sample_by_count(stored(known, "toxicity-windows"), "_toxic", rows_per_class, F.col("_text"))
    known = stored(known, "toxicity-sample")
    sizes = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model(bias=float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 if share else -30.0)
    least = max(2, n_toxic // 300)
    counts = known.mapInArrow(_counts, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= least)
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    top = counts.withColumn("score", lift * F.sqrt("toxic")).filter(lift > 1.5).orderBy(
        F.desc("score"), F.length("entry"), "entry").limit(candidates)
    names = [r["entry"] for r in top.collect()]
    number = {e: k for k, e in enumerate(names)}

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[number[e] for e in entries(t) & number.keys()] for t in b.column(0).to_pylist()]
            pats = [patterns(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(pats, pa.list_(pa.int32()))],
                ["toxic", "found", "patterns"])

    seen = known.mapInArrow(marks, "toxic int, found array<int>, patterns array<int>").collect()  # bounded by the sample
    label = np.fromiter((r["toxic"] for r in seen), bool, len(seen))
    present = np.zeros((len(seen), len(names)), bool)
    pats = np.zeros((len(seen), len(PATTERNS)), bool)
    for k, r in enumerate(seen):
        present[k, r["found"]] = True
        pats[k, r["patterns"]] = True
    chosen = _cover(present, label, voters, least) if names else []
    votes = np.hstack([pats, present[:, chosen]]).astype(float)
    post, rate, corr, _ = label_model(votes, label)
    weights, bias = logistic(votes, post)
    model = Model(weights=weights, bias=bias, correlations=corr)
    for k, c in enumerate(chosen, start=len(PATTERNS)):
        if "*" in names[c]:
            begin, _, times = names[c].partition("*")
            model.beginnings[begin, int(times)] = k
        else:
            model.words[names[c]] = k
    named = [*PATTERNS, *(names[c] for c in chosen), "label"]
    model.accuracies = [(n, float(r[1]), float(1 - r[0])) for n, r in zip(named, rate)]
    return model


def score(model: Model, text: Column) -> Column:
    """Score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], index=batch.index, dtype=float)

    return run(text)
