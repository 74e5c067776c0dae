"""HyperMinHash near-duplicates against all pairs of sets, and its registers and estimates against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from iotlens.llm import minhash
from iotlens.llm.components import components


def brute(rows):
    """Size, component and kept flag of every row by comparing all sets that share a shingle."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where, first = defaultdict(list), {}
    for k, s in enumerate(sets):
        if s and (same := first.setdefault(frozenset(s), k)) != k:
            parent[find(k)] = find(same)
            continue
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
    return sorted(((i, len(sets[k]), c := least.get(find(k)), i == c) for k, (i, _) in enumerate(rows)), key=str)


def got(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).repartition(4)
    out = minhash.near_dedup(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted((tuple(r) for r in out), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    passage, base = [word() for _ in range(40)], [word() for _ in range(60)]
    rows = []
    for _ in range(50):
        rows.append([word() for _ in range(rnd.randint(1, 80))])
        rows.append(passage + [word() for _ in range(rnd.randint(0, 12))])
        near = base[:]
        for _ in range(rnd.randint(0, 2)):
            near[rnd.randrange(60)] = word()
        rows.append(near)
        rows.append([w.upper() for w in rows[rnd.randrange(len(rows))]])
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_all_pairs(spark):
    rows = corpus(1)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = corpus(3)[:40] + [(None, "a b c d e"), (None, "x y"), (200, "x y"), (201, None), (202, None), (203, " \t"), (204, ""), (1, "other text of one id"), (1, "other text of one id")]
    rows += [(300, "w " * 300_000), (301, "W  " * 300_000), (302, "w"), (303, "w w"), (304, "w w w w")]
    assert got(spark, rows) == brute(rows)


def test_open_keys_in_cells(spark, monkeypatch):
    """Large keys are cut into chunks: chains and strays of one key must still be found."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    monkeypatch.setattr(minhash, "NEAREST", 1)
    rows = corpus(4)
    rnd = random.Random(4)
    text = [f"c{k}" for k in range(90)]
    for k in range(60):  # a chain: neighbours are linked, ends aren't
        text = text[:]
        text[(k * 7) % 90] = f"n{rnd.random()}"
        rows.append((1000 + k, " ".join(text)))
    assert got(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == []
    rows = corpus(5)[:30]
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], "doc_id long, text string, class int, c int, _id int, component_id string")
    out = minhash.near_dedup(df).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows)


def test_given_documents(spark, medium):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{medium}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    df = spark.read.parquet(f"{medium}/documents.parquet")
    assert sorted((tuple(r) for r in minhash.near_dedup(df).collect()), key=str) == brute(rows)


def test_registers_by_hand():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    least = {}
    for h in s.tolist():
        b, v = h >> 56, (h & ((1 << 56) - 1)) >> 3
        least[b] = min(v, least.get(b, v))
    got = minhash.registers([np.empty(0, np.uint64), s, s[:1]])
    for b in range(256):
        want = 0
        if b in least:
            bits = f"{least[b]:053b}"
            zeros = 53 - len(bits.lstrip("0"))
            want = (zeros + 1) << 10 | int((bits[zeros + 1 :] + "0" * 11)[:10], 2)
        assert got[1][b] == want
    assert not got[0].any() and (got[2] > 0).sum() == 1
    full = minhash.filled(got)
    assert (full[1:] > 0).all() and not full[0].any() and len(set(full[2])) == 1


@pytest.mark.parametrize("size", [200, 2000, 50_000])
def test_estimates(size):
    rng = np.random.default_rng(size)
    draws = [np.unique(rng.integers(0, 1 << 63, 2 * size).astype(np.uint64) << np.uint64(1)) for _ in range(30)]
    a = [np.sort(d[:size]) for d in map(rng.permutation, draws)]
    far = minhash.registers([np.sort(rng.permutation(d)[:size]) for d in draws])
    ra = minhash.registers(a)
    equal, want = ((ra[1:] == far[:-1]) & (ra[1:] != 0)).sum(), 29 * minhash.collisions(np.array([size]), np.array([size]))[0]
    assert abs(equal - want) < 6 * max(want, 1) ** 0.5 + 2
    b = [np.unique(np.r_[s[: size * 9 // 10], rng.integers(0, 1 << 63, size // 10).astype(np.uint64) << np.uint64(1)]) for s in (rng.permutation(s) for s in a)]
    share, either = minhash.similarity(ra, minhash.registers([np.sort(s) for s in b]), np.full(30, size), np.full(30, size))
    assert abs(share.mean() - 0.9 / 1.1) < 0.03 and either.max() <= 256


def test_margin_is_the_binomial_tail():
    from fractions import Fraction
    from math import comb

    least = minhash.least_equal(256, 4, 5)
    for n in (1, 5, 40, 256):
        tail = [sum(Fraction(4, 5) ** m * Fraction(1, 5) ** (n - m) * comb(n, m) for m in range(k)) for k in (int(least[n]), int(least[n]) + 1)]
        assert tail[0] <= Fraction(1, 10**9) < tail[1]


def test_components_settle_or_raise(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (100, 101)], "a long, b long")
    assert {r["node"]: r["least"] for r in components(edges, "t").collect()} == {k: 0 for k in range(1, 61)} | {101: 100}
    assert components(edges.filter("a < 0"), "t").collect() == []
    with pytest.raises(RuntimeError, match="settled"):
        components(edges, "t", rounds=2)
