"""Language identification by words first, backing off to ever shorter character n-grams.

A known word is scored by its log frequency in each language.  An unseen word is scored by its longest known
n-grams (five letters first): the mean of their log frequencies; where none of a length is known, the next
shorter length is tried.  A text's score in a language is the sum over its words; the prediction is the language of the
highest sum (ties: first by name), and the score its posterior share.

Words are maximal runs of letters and marks, lower-cased.  Null texts and texts without a letter give ``und`` and 0, as
do all texts if there was nothing to learn from.  The model is fitted on about ``rows_per_language`` labelled rows of each
language and keeps the most frequent words and n-grams, so its size is bounded; every whole text is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.llm.bpe import slices
from iotlens.llm.common import factorize, sample_by_count

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word between its borders; single letters without them."""
    padded = word if n == 1 else f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language of known words, and of n-grams of each order."""

    def __init__(self, languages: list[str], counts: dict[int, dict[str, np.ndarray]], totals: dict[int, np.ndarray]) -> None:
        self.languages = languages
        self.tables: dict[int, dict[str, np.ndarray]] = {}
        self.floor: dict[int, np.ndarray] = {}
        for order, rows in counts.items():
            size = totals[order] + 0.5 * (len(rows) + 1)
            self.floor[order] = np.log(0.5 / size)
            self.tables[order] = {k: np.log((v + 0.5) / size) for k, v in rows.items()}

    def word_score(self, word: str) -> np.ndarray:
        known = self.tables.get(0, {}).get(word)
        if known is not None:
            return known
        for n in ORDERS:
            table = self.tables.get(n, {})
            found = [table[g] for g in grams(word, n) if g in table]
            if found:
                return sum(found) / len(found)
        return self.floor.get(1, np.zeros(len(self.languages)))

    def predict(self, texts: list[str | None], cache: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
        flat, words, lens = factorize([words_of(t) for t in texts])
        if len(cache) > 300_000:
            for w in list(islice(cache, 100_000)):
                del cache[w]
        rows = []
        for w in words:
            row = cache.get(w)
            if row is None:
                row = cache[w] = self.word_score(w)
            rows.append(row)
        sums = np.zeros((len(texts), len(self.languages)))
        if len(flat) and self.languages:
            table = np.array(rows)
            owner = np.repeat(np.arange(len(lens)), lens)
            for k in range(len(self.languages)):
                sums[:, k] = np.bincount(owner, table[flat, k], minlength=len(lens))
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        best = sums.argmax(1)
        share = np.exp(sums - sums.max(1, keepdims=True))
        top = 1 / share.sum(1)
        return ([self.languages[b] if n else UNKNOWN for b, n in zip(best, lens)], [float(s) if n else 0.0 for s, n in zip(top, lens)])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
            ["lang", "item", "n"])
        counts.clear()
        return batch

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w, n in Counter(words_of(text)).items():
                counts[lang, w] += n
        if len(counts) > 500_000:
            yield out()
    yield out()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        cols = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.int32(), pa.string(), pa.string()))]
        batch = pa.RecordBatch.from_arrays([*cols, pa.array(list(counts.values()), pa.int64())], ["kind", "lang", "item", "n"])
        counts.clear()
        return batch

    for b in batches:
        for lang, word, n in zip(*(b.column(k).to_pylist() for k in range(3))):
            for order in ORDERS:
                for g in grams(word, order):
                    counts[order, lang, g] += n
            if len(counts) > 500_000:
                yield out()
    yield out()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 4000, max_words: int = 60_000, max_grams: int = 30_000) -> Model:
    """Learns from the rows of ``docs`` with a language."""
    known = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    known = sample_by_count(known, "_lang", rows_per_language, F.col("_text"))
    words = known.mapInArrow(_word_counts, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    all_grams = words.mapInArrow(_gram_counts, "kind int, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    counted = words.select(F.lit(0).alias("kind"), "lang", "item", "n").unionByName(all_grams).persist()
    try:
        totals = counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
        languages = sorted({r["lang"] for r in totals})
        place = {x: k for k, x in enumerate(languages)}
        total = {kind: np.zeros(len(languages)) for kind in (0, *ORDERS)}
        for r in totals:
            total[r["kind"]][place[r["lang"]]] = r["n"]
        items = counted.groupBy("kind", "item").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
        counts: dict[int, dict[str, np.ndarray]] = {}
        for kind in (0, *ORDERS):
            own = items.filter(F.col("kind") == kind).orderBy(F.desc("all"), "item").limit(max_grams if kind else max_words)
            counts[kind] = {}
            for r in own.collect():  # at most max_words or max_grams rows
                row = np.zeros(len(languages))
                for x in r["by"]:
                    row[place[x["lang"]]] = x["n"]
                counts[kind][r["item"]] = row
    finally:
        counted.unpersist()
    return Model(languages, counts, total)


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct ``lang_pred, score`` of each text; the model travels as one bounded broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, cache = shared.value, {}
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for part in slices(batch):
                a, b = own.predict(part, cache)
                names += a
                scores += b
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return run(F.col(text))
