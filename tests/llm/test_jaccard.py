"""The Jaccard join against all pairs of sets, on planted copies, hot groups and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from iotlens.llm import jaccard


def brute(rows):
    """Component of every row by comparing all sets that share a shingle."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    shared = Counter((a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    out = jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in out), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(60)]
    rows = []
    for k in range(60):
        rows.append([word() for _ in range(rnd.randint(1, 80))])
        rows.append(passage + [word() for _ in range(rnd.randint(0, 12))])
        near = base[:]
        for _ in range(rnd.randint(0, 2)):
            near[rnd.randrange(60)] = word()
        rows.append(near)
        rows.append([w.upper() for w in rows[rnd.randrange(len(rows))]])
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


def test_join_equals_brute_force_with_long_lists(spark):
    rows = corpus(1)
    assert got(spark, rows) == brute(rows)


def test_pivots_and_second_round(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 2)
    rows = corpus(2)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one  two\n"), (7, "two one"), (None, "one two"),
            (8, "a b c d e"), (8, "a b c d e"), (9, "x " * 30_000), (10, "x " * 20_000), (11, "ünï ÜNÏ a b c"), (12, "ünï ÜNÏ A b c")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("n", [1, 5, 64, 700])
def test_sketches_never_rule_out(n):
    rnd = np.random.default_rng(n)
    for _ in range(20):
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * rnd.random()) + 1], rnd.integers(0, 1 << 63, rnd.integers(0, n + 1)).astype(np.uint64)]))
        assert jaccard.differ(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_keep_one_row_of_each_group_with_extra_columns(spark):
    rows = [(3, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (5, "other words are in this one", 3), (6, None, 4), (7, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r)[0] for r in kept.collect()) == [2, 5, 6, 7]
