"""Ranked search against all scores computed in plain Python, in small blocks so that bounds and merges matter."""

import math
import random
import re

import pytest

from iotlens.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in wanted.items():
        df = {t: sum(t in w for _, w in held) for t in terms}
        scores = []
        for i, w in held:
            m = 50 + (50 * len(w) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for r, (s, none, i) in enumerate(sorted(scores)[:k]):
            out.append((item, r + 1, None if none else i, -s))
    return sorted(out, key=str)


def got(spark, docs, items, k, **names):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(d, q, k).collect()), key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "été", "x1y"]
    pick = lambda: vocabulary[min(int(rnd.expovariate(0.02)), len(vocabulary) - 1)]
    docs = [(k, ", ".join(pick() for _ in range(rnd.choice([3, 20, 60])))) for k in range(n)]
    docs += [(k + n, docs[k % 7][1]) for k in range(60)]  # ties
    items = [(k, " ".join(pick().upper() for _ in range(rnd.randint(1, 25)))) for k in range(12)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 30)
    docs, items = corpus(seed)
    assert got(spark, docs, items, 10) == brute(docs, items, 10)


def test_odd_rows(spark):
    docs, items = corpus(4, 40)
    docs += [(None, docs[0][1]), (None, None), (900, None), (901, ""), (902, "... !"), (3, docs[3][1]), (3, docs[3][1]), (903, "w1 " * 200_000)]
    items += [(None, "w1 w2"), (50, None), (51, "?!"), (52, "zzz unseen"), (3, "w200 w1"), (3, "w200 w1")]
    assert got(spark, docs, items, 50) == brute(docs, items, 50)


def test_item_groups_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(ranked, "GROUP_TERMS", 20)
    docs, items = corpus(5, 60)
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, item_id int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert sorted((tuple(r) for r in ranked.search(d, q, 5).collect()), key=str) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = corpus(6, 10)
    assert got(spark, [], items, 5) == []
    assert got(spark, docs, [], 5) == []


def test_no_accumulators_after_the_bound():
    """Frequent terms that can't lift a document to the bound only update what the rare term found."""
    import numpy as np

    docs = np.zeros(4, ranked.DOC)
    docs["id"], docs["n"] = [7, 5, 6, 4], 10
    post = np.array([(2, 3), (0, 1), (1, 1), (2, 1), (3, 1)], ranked.POSTING)
    lists = ranked.Lists(docs.tobytes(), np.array([0, 1], "<i4").tobytes(), np.array([1, 4], "<i4").tobytes(), post.tobytes(), np.array([5000, 1]), 4, 40)
    full = ranked.best(lists, [0, 1], 0, 4)
    limited = ranked.best(lists, [0, 1], 1_000_000, 4)
    assert full[0].tolist() == [0, 1, 2, 3]
    assert limited[0].tolist() == [2] and limited[1][0] == full[1][full[0].tolist().index(2)]


def test_long_products_stay_exact():
    import numpy as np

    n = np.array([10**9])
    assert ranked.norms(n, 10**12, 10**16)[0] == 50 + (50 * 10**9 * 10**12) // 10**16
