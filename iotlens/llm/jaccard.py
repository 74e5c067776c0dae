"""Exact Jaccard join of documents on word shingles, and the groups that its links form.

A document is the set of 64-bit hashes of its distinct shingles of five words.  Equal sets form a class, named by a
128-bit digest; only classes are joined.

1. *Order.*  A counting table of fixed size (``BINS`` counters, summed over all documents) orders shingles from rare to
   frequent.  Any order gives the same result; this one keeps shared passages out of the prefixes.
2. *Index.*  Each class posts its prefix, the only part where a partner must show up, with the position of
   each shingle and a hash of the shingle before it.  Posts travel packed, by range of the shingle's hash.
3. *Block skipping.*  Within a list, posts are grouped by the preceding shingle: pairs that also share that one already met
   in its list, so the whole block is skipped.  Of the rest, pairs whose positions and sizes leave no room for the
   threshold are skipped.
4. *Answers from a similar set.*  In lists of more than ``SHORT`` sets each remaining set is first compared with one pivot only.
   What a pivot links is one group already: its members take over the pivot's answer.  Two later rounds compare members of
   different groups: first each one's ``NEAREST`` by sketch, then all that are still possible.  Shorter lists are compared whole.
5. *Verification.*  Parity sketches (a quarter byte per shingle) bound how much two sets share and rule most false candidates out.
   The whole texts of the rest meet at their pivot (split by degree) and are compared exactly.

Links of all rounds give the groups by alternating star contraction.  No link between different texts is
lost, though not every link inside a group is listed.  Documents without words are linked with nothing, not even each other.
Repeated rows and equal texts share a class; null ids sort last in a group's name.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotlens.llm.bpe import slices
from iotlens.llm.common import hashed_words, small, stored, unused, window_hashes
from iotlens.llm.components import components

WIDTH = 5
BINS = 1 << 18
CHUNK = 1 << 14
SHORT = 16
NEAREST = 4
TASK_BYTES = 24_000_000
POSTS_PER_PART = 1_000_000

CLASS = np.dtype([("name", ">u8", 2), ("size", "<u4")])
WAITING = np.dtype([("list", "<u8"), ("prev", "<u8"), ("pos", "<u2")])
POST = np.dtype([("key", "<u8"), ("prev", "<u8"), ("set", "<u4"), ("pos", "<u2")])


def need(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least intersection with which sets of sizes a and b reach num/den: den*i >= num*(a+b-i)."""
    return -(-num * (a + b) // (num + den))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts of one to four words are one shingle."""
    hashed, lens = hashed_words(texts, lower=True)
    windows = window_hashes(hashed, WIDTH)
    out, start = [], 0
    for n in lens.tolist():
        if n >= WIDTH:
            out.append(np.unique(windows[start : start + n - WIDTH + 1]))
        else:
            out.append(window_hashes(hashed[start : start + n], n) ^ np.uint64(n) if n else np.empty(0, np.uint64))
        start += n
    return out


def class_name(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


BIN_SHIFT = np.uint64(64 - 18)


def bins(s: np.ndarray) -> np.ndarray:
    return (s >> BIN_SHIFT).astype(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set: a differing element flips one bit, so two sketches differ in at most as many bits as the sets in elements."""
    bits = 64
    while bits < 2 * len(s) and bits < 1 << 20:
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """Least number of elements in which the sets of two sketches differ; the longer sketch is folded."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its class and set size; then the task's counting table in chunks."""
    table = np.zeros(BINS, np.int64)
    seen: set[bytes] = set()
    id_type = None

    def rows(ids, hashes, names, sizes, sketches, chunk, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, hashes, pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())],
            ["_id", "_hash", "class", "size", "sketch", "chunk", "counts"])

    for b in batches:
        id_type = b.column(0).type
        names, sizes, sketches = [], [], []
        for part in slices(b.column(2).to_pylist()):
            sets = shingle_sets(part)
            own = list(map(class_name, sets))
            new = [s for s, name in zip(sets, own) if len(s) and name not in seen]
            if new:
                table += np.bincount(bins(np.concatenate(new)), minlength=BINS)
            seen.update(own)
            if len(seen) > 500_000:  # forgotten copies count again, which only changes the order
                seen.clear()
            names += own
            sizes += map(len, sets)
            sketches += [sketch(s) if len(s) else None for s in sets]
        yield rows(b.column(0), b.column(1), names, sizes, sketches, [None] * len(names), [None] * len(names))
    if id_type is not None:
        for k in range(0, BINS, CHUNK):
            part = table[k : k + CHUNK]
            if part.any():
                yield rows(pa.nulls(1, id_type), pa.nulls(1, pa.int64()), [None], [None], [None], [k // CHUNK], [part.astype("<i8").tobytes()])


def _add_tables(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, "<i8")
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [total.tobytes()]})


def _posts(levels: np.ndarray, parts: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = []
        sizes: list[int] = []
        posts: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            all_posts = np.concatenate(posts) if posts else np.empty(0, POST)
            part = (all_posts["key"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts), side="right")
            table = np.zeros(len(names), CLASS)
            table["name"] = np.frombuffer(b"".join(names), ">u8").reshape(-1, 2)
            table["size"] = sizes
            start, out = 0, []
            for k, end in enumerate(ends.tolist()):
                if end > start:
                    own = all_posts[order[start:end]]
                    used, own["set"] = np.unique(own["set"], return_inverse=True)
                    out.append((k, table[used].tobytes(), own.tobytes()))
                start = end
            names.clear(), sizes.clear(), posts.clear()
            held = 0
            for i in range(0, len(out), 64):
                cols = list(zip(*out[i : i + 64]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["part", "sets", "posts"])

        for b in batches:
            for text_part in slices(b.column(0).to_pylist()):
                for s in shingle_sets(text_part):
                    name = class_name(s)
                    if not len(s) or name in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(name)  # a copy posted twice is merged in its lists
                    n = len(s)
                    length = n - int(-(-num * n // den)) + 1
                    order = np.lexsort((s, levels[bins(s)]))[:length]
                    own = np.zeros(length, POST)
                    own["key"] = s[order]
                    own["prev"][1:] = s[order[:-1]]
                    own["set"] = len(names)
                    own["pos"] = np.minimum(np.arange(length), 65_535)
                    names.append(name)
                    sizes.append(n)
                    posts.append(own)
                    held += length
                if held > 2_000_000:
                    yield from flush()
        yield from flush()

    return run


def _lists(chunks: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posts of one part in lists of equal key with at least two classes: names, sizes, posts and list borders."""
    names, sizes, posts, base = [], [], [], 0
    for sets, packed in chunks:
        t = np.frombuffer(sets, CLASS)
        p = np.frombuffer(packed, POST).copy()
        p["set"] += base
        base += len(t)
        names.append(t["name"].astype(np.uint64))
        sizes.append(t["size"].astype(np.int64))
        posts.append(p)
    all_names, number = np.unique(np.concatenate(names), axis=0, return_inverse=True)  # in order of the bytes
    number = number.reshape(-1)
    all_sizes = np.zeros(len(all_names), np.int64)
    all_sizes[number] = np.concatenate(sizes)
    p = np.concatenate(posts)
    p["set"] = number[p["set"]]
    keys, counts = np.unique(p["key"], return_counts=True)
    p = p[counts[np.searchsorted(keys, p["key"])] > 1]
    p = p[np.lexsort((p["set"], all_sizes[p["set"]], p["key"]))]
    twice = np.zeros(len(p), bool)
    twice[1:] = (p["key"][1:] == p["key"][:-1]) & (p["set"][1:] == p["set"][:-1])
    p = p[~twice]
    borders = np.flatnonzero(np.r_[True, p["key"][1:] != p["key"][:-1], True]) if len(p) else np.zeros(1, np.int64)
    return all_names, all_sizes, p, borders


def _possible(i: np.ndarray, j: np.ndarray, p: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs of posts of one list that can still reach the threshold and did not meet in an earlier list."""
    a, b = sizes[p["set"][i]], sizes[p["set"][j]]
    room = np.minimum(a - p["pos"][i], b - p["pos"][j])  # shared at most, if nothing before is shared
    fits = room >= need(a, b, num, den)
    first = (p["prev"][i] != p["prev"][j]) | (p["pos"][i] == 0) | (p["pos"][j] == 0)
    return fits & first


def _candidates(num: int, den: int):
    """Candidate pairs of a part, and the posts of lists that only met their pivots."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, sizes, p, borders = _lists(list(zip(pdf["sets"], pdf["posts"])))
        pairs: list[np.ndarray] = []
        later: list[np.ndarray] = []
        lens = np.diff(borders)
        ends = np.repeat(borders[1:], lens)
        open_posts = np.flatnonzero(np.repeat(lens <= SHORT, lens))
        for shift in range(1, SHORT):  # every pair of the short lists, all lists at once
            open_posts = open_posts[open_posts + shift < ends[open_posts]]
            if not len(open_posts):
                break
            ok = open_posts[_possible(open_posts, open_posts + shift, p, sizes, num, den)]
            pairs.append(np.column_stack([p["set"][ok], p["set"][ok + shift]]))
        for start, n in zip(borders[:-1][lens > SHORT].tolist(), lens[lens > SHORT].tolist()):
            own = np.arange(start, start + n)
            prev, pos = p["prev"][own], p["pos"][own]
            if (pos > 0).all() and (prev == prev[0]).all():
                continue  # the block already met in the list before
            later.append(own)
            waiting = own
            while len(waiting) > 1:
                pivot = waiting[0]
                if (p["pos"][waiting] > 0).all() and (p["prev"][waiting] == p["prev"][pivot]).all():
                    break
                size = sizes[p["set"][waiting]]
                near = waiting[1 : np.searchsorted(size, size[0] * den // num, side="right")]
                ok = near[_possible(np.full(len(near), pivot), near, p, sizes, num, den)]
                if len(ok):
                    pairs.append(np.column_stack([np.full(len(ok), p["set"][pivot]), p["set"][ok]]))
                    waiting = np.setdiff1d(waiting[1:], ok, assume_unique=True)
                else:
                    waiting = waiting[1:]
        got = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
        raw = names.astype(">u8")
        name = lambda k: [raw[x].tobytes() for x in k]
        out = pd.DataFrame({"a": name(got[:, 0]), "b": name(got[:, 1]), "posts": None})
        if later:
            q = p[np.concatenate(later)]
            q = q[np.argsort(q["set"], kind="stable")]
            packed = np.zeros(len(q), WAITING)
            packed["list"], packed["prev"], packed["pos"] = q["key"], q["prev"], q["pos"]
            starts = np.flatnonzero(np.r_[True, q["set"][1:] != q["set"][:-1]])
            own = [x.tobytes() for x in np.split(packed, starts[1:])]
            out = pd.concat([out, pd.DataFrame({"a": name(q["set"][starts]), "b": None, "posts": own})], ignore_index=True)
        return out

    return run


CANDIDATE = "a binary, b binary, posts binary"
PACKED = "part int, names binary, sizes binary, groups binary, lengths binary, sketches binary, posts binary"


def _repack(parts: int):
    """Classes with all their waiting posts to packed pieces by list: a class and its sketch stand once in each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes, bytes]] = []
        waiting: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            p = np.concatenate(waiting)
            posts = np.zeros(len(p), POST)
            posts["key"], posts["prev"], posts["pos"] = p["list"], p["prev"], p["pos"]
            posts["set"] = np.repeat(np.arange(len(held)), [len(w) for w in waiting])
            part = (p["list"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts), side="right").tolist()
            for k, (start, end) in enumerate(zip([0, *ends], ends)):
                if end == start:
                    continue
                own = posts[order[start:end]]
                used, own["set"] = np.unique(own["set"], return_inverse=True)
                sets = [held[u] for u in used.tolist()]
                row = [k, b"".join(x[0] for x in sets), np.array([x[1] for x in sets], "<i8").tobytes(), b"".join(x[2] for x in sets),
                       np.array([len(x[3]) for x in sets], "<i8").tobytes(), b"".join(x[3] for x in sets), own.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.binary()] * 6])],
                                                 ["part", "names", "sizes", "groups", "lengths", "sketches", "posts"])
            held.clear(), waiting.clear()
            size = 0

        for b in batches:
            for r in b.to_pylist():
                held.append((r["a"], r["size"], r["group"], r["sketch"]))
                waiting.append(np.concatenate([np.frombuffer(x, WAITING) for x in r["posts"]]))
                size += len(r["sketch"]) + 30 * len(waiting[-1])
                if size > 16_000_000:
                    yield from flush()
        if held:
            yield from flush()

    return run


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest."""
    least = min(map(len, sketches))
    rows = np.zeros((len(sketches), least // 8), np.uint64)
    for k, raw in enumerate(sketches):
        rows[k] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, least // 8), axis=0)
    return rows


def _across(num: int, den: int, nearest: int | None):
    """Pairs of one list whose sets are in different groups and still possible; each set's ``nearest`` by sketch, or all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names: list[bytes] = []
        group_names: list[bytes] = []
        sketches: list[bytes] = []
        all_sizes, all_posts = [], []
        for r in pdf.itertuples(index=False):
            posts = np.frombuffer(r.posts, POST).copy()
            posts["set"] += len(names)
            all_posts.append(posts)
            all_sizes.append(np.frombuffer(r.sizes, "<i8"))
            names += [r.names[k : k + 16] for k in range(0, len(r.names), 16)]
            group_names += [r.groups[k : k + 16] for k in range(0, len(r.groups), 16)]
            ends = np.cumsum(np.frombuffer(r.lengths, "<i8")).tolist()
            sketches += [r.sketches[x:y] for x, y in zip([0, *ends], ends)]
        set_sizes, p = np.concatenate(all_sizes), np.concatenate(all_posts)
        set_groups = pd.factorize(np.array(group_names, object))[0]
        by_name = np.argsort(np.argsort(np.array(names, object)))
        p = p[np.lexsort((by_name[p["set"]], set_sizes[p["set"]], p["key"]))]
        sets = p["set"].astype(np.int64)
        sizes, groups, keys = set_sizes[sets], set_groups[sets], p["key"]
        p["set"] = np.arange(len(p))
        borders = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        out: set[tuple[bytes, bytes]] = set()
        for start, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if (groups[start:end] == groups[start]).all():
                continue  # one group already
            own, most = groups[start:end], np.bincount(groups[start:end]).argmax()
            bits = folded([sketches[x] for x in sets[start:end]])
            # The largest group's sets are only met by the others: each of these looks at smaller and larger ones of that group.
            for i in (start + np.flatnonzero(own != most)).tolist():
                low = start + np.searchsorted(sizes[start:end], -(-sizes[i] * num // den), side="left")
                high = start + np.searchsorted(sizes[start:end], sizes[i] * den // num, side="right")
                j = np.arange(low, high)
                j = j[(groups[j] == most) | ((j > i) & (groups[j] != groups[i]))]
                j = j[_possible(np.full(len(j), i), j, p, sizes, num, den)]
                apart = np.bitwise_count(bits[j - start] ^ bits[i - start]).sum(1).astype(np.int64)
                fits = apart <= sizes[i] + sizes[j] - 2 * need(sizes[i], sizes[j], num, den)
                j = j[fits][np.argsort(apart[fits], kind="stable")[:nearest]]
                out.update((names[sets[min(i, x)]], names[sets[max(i, x)]]) for x in j.tolist())
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    return run


def _verify(num: int, den: int):
    """Pairs of a pivot and a member that reach the threshold, among the texts of a task: enough of them to connect all that are linked there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets: dict[bytes, np.ndarray] = {}
        texts = pdf.drop_duplicates(["class", "text"])
        names = iter(texts["class"])
        for part in slices(texts["text"]):
            for s in shingle_sets(part):
                name = next(names)
                if class_name(s) == name:  # an id may have other texts too
                    sets[name] = s
        linked = []
        parent: dict[bytes, bytes] = {}

        def root(k: bytes) -> bytes:
            while (up := parent.get(k, k)) != k:
                parent[k] = parent.get(up, up)
                k = up
            return k

        for a, b in pdf.loc[~pdf["is_pivot"], ["a", "class"]].drop_duplicates().itertuples(index=False):
            if root(a) == root(b):
                continue  # follows from links already found here
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if den * both >= num * (len(x) + len(y) - both):
                linked.append((a, b))
                parent[root(b)] = root(a)
        return pd.DataFrame(linked, columns=["a", "b"])

    return run


def near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sketches leave the threshold possible."""
    a = classes.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))

    @F.pandas_udf("boolean")
    def possible(na: pd.Series, sa: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.Series:
        total = (na + nb).to_numpy()
        most = total - 2 * need(na.to_numpy(), nb.to_numpy(), num, den)
        return pd.Series([differ(x, y) for x, y in zip(sa, sb)], dtype="int64").to_numpy() <= pd.Series(most)

    return pairs.join(a, "a").join(b, "b").filter(possible("na", "sa", "nb", "sb")).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of classes that reach the threshold; a pivot's members are cut into pieces of about ``TASK_BYTES`` of text."""
    possible = stored(near(pairs, classes, num, den), "jaccard-near")
    weighed = possible.join(classes.select(F.col("class").alias("b"), (8 * F.col("size")).alias("bytes")), "b")
    loads = weighed.groupBy("a").agg(F.sum("bytes").alias("load"))
    pieces = F.greatest(F.ceil(2 * F.col("load") / TASK_BYTES), F.lit(1))
    dealt = stored(weighed.join(loads, "a").withColumn("salt", F.pmod(F.xxhash64("b"), pieces).cast("int")).select("a", "b", "salt", "bytes"), "jaccard-pairs")
    total = dealt.agg(F.sum("bytes")).first()[0] or 0
    roles = dealt.select(F.col("b").alias("class"), "a", "salt", F.lit(False).alias("is_pivot")).unionByName(
        dealt.select(F.col("a").alias("class"), "a", "salt", F.lit(True).alias("is_pivot")).distinct())
    tasks = max(1, ceil(4 * total / TASK_BYTES))
    roles = roles.withColumn("task", F.pmod(F.xxhash64("a", "salt"), F.lit(tasks)))
    needed = roles.join(classes.select("class", F.col("_id").alias("_at"), F.col("_hash").alias("_text_hash")), "class")
    texts = docs.join(needed, (docs["_hash"] == needed["_text_hash"]) & docs["_id"].eqNullSafe(needed["_at"]))
    return texts.select("task", "a", "class", "is_pivot", F.col("_text").alias("text")).groupBy("task").applyInPandas(
        _verify(num, den), "a binary, b binary")


def groups(edges: DataFrame) -> DataFrame:
    """``class, group``: smallest class name reachable."""
    return components(edges, "jaccard-edges").select(F.col("node").alias("class"), F.col("least").alias("group"))


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``_id, _hash, class, size, group``; threshold ``num/den``."""
    base = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    id_type = base.schema["_id"].dataType.simpleString()
    first = stored(base.mapInArrow(_summaries, f"_id {id_type}, _hash long, class binary, size long, sketch binary, chunk int, counts binary"), "jaccard-classes")
    classes = first.filter(F.col("chunk").isNull()).select("_id", "_hash", "class", "size", "sketch")
    linkable = classes.filter(F.col("size") > 0)
    tables = first.filter(F.col("chunk").isNotNull()).select("chunk", "counts").groupBy("chunk").applyInPandas(_add_tables, "chunk int, counts binary").collect()
    counts = np.zeros(BINS, np.int64)
    for r in tables:  # BINS counters in all
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i8")
    typical = max(1.0, float(np.median(counts[counts > 0]))) if counts.any() else 1.0
    levels = np.clip(np.round(2 * np.log2(np.maximum(counts, 1) / typical)), 0, 60).astype(np.int8)
    total = linkable.agg(F.sum(F.col("size") * (den - num) / den + 1)).first()[0] or 0
    parts = max(8, ceil(total / POSTS_PER_PART))
    packed = base.select("_text").mapInArrow(_posts(levels, parts, num, den), "part int, sets binary, posts binary")
    found = stored(packed.groupBy("part").applyInPandas(_candidates(num, den), CANDIDATE), "jaccard-candidates")
    # One row of each class stands for it: found by id and hash of the text, as ids may repeat or be null.
    by_class = linkable.groupBy("class").agg(F.min(F.struct("_id", "_hash", "size", "sketch")).alias("_at")).select("class", "_at.*")
    pairs = found.filter(F.col("b").isNotNull()).select("a", "b").distinct()
    edges = stored(links(base, by_class, pairs, num, den), "jaccard-links")
    named = groups(edges)
    # Lists that only met their pivots, by class: joins with groups and sketches are one row a class, however many lists it is in.
    lists = found.filter(F.col("b").isNull()).groupBy("a").agg(F.collect_list("posts").alias("posts"))
    lists = stored(lists.join(by_class.select(F.col("class").alias("a"), "size", "sketch"), "a"), "jaccard-waiting")
    held = F.aggregate("posts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    tasks = 8 * max(1, ceil((lists.agg(F.sum(held)).first()[0] or 0) / WAITING.itemsize / POSTS_PER_PART))
    tested = pairs
    # First each set's nearest in other groups, which joins most groups; then whatever is still possible between different groups.
    for nearest in (NEAREST, None):
        placed = lists.join(named, lists["a"] == named["class"], "left").select("a", "size", F.coalesce("group", "a").alias("group"), "sketch", "posts")
        rest = placed.mapInArrow(_repack(tasks), PACKED).groupBy("part").applyInPandas(_across(num, den, nearest), "a binary, b binary")
        rest = stored(rest.distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-rest")
        if not rest.isEmpty():
            edges = edges.unionByName(stored(links(base, by_class, rest, num, den), "jaccard-links"))
            named = groups(edges)
            tested = tested.unionByName(rest)
    return classes.join(named, "class", "left").withColumn("group", F.coalesce("group", "class"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, class_id, component_id``."""
    rows = labelled(docs, doc_id, text, num, den)
    names = rows.filter(F.col("size") > 0).groupBy("group").agg(F.min("_id").alias("component_id"))
    return rows.join(names, "group", "left").select(
        F.col("_id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("class").alias("class_id"),
        F.coalesce("component_id", "_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; rows without words all stay."""
    rows = stored(labelled(docs, doc_id, text, num, den), "jaccard-labelled")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")).alias("r")
    chosen = rows.filter(F.col("size") > 0).groupBy("group").agg(first).select("r._id", "r._hash").unionByName(
        rows.filter(F.col("size") == 0).select("_id", "_hash").distinct())
    h = unused(docs, "_near")  # no helper column clashes with a column of docs
    hash_of, kept, kept_hash = f"{h}_hash", f"{h}_kept", f"{h}_kept_hash"
    chosen = small(chosen.select(F.col("_id").alias(kept), F.col("_hash").alias(kept_hash)), "jaccard-kept")
    hashed = docs.withColumn(hash_of, F.xxhash64(docs[text]))
    out = hashed.join(chosen, (F.col(hash_of) == F.col(kept_hash)) & docs[doc_id].eqNullSafe(F.col(kept)), "left_semi")
    again = rows.filter(F.col("size") > 0).groupBy("_id", "_hash").count().filter("count > 1")
    if not again.isEmpty():  # whole rows that repeat: the join keeps them all
        empty = F.xxhash64(F.lit(""))
        out = out.filter(F.col(hash_of) != empty).dropDuplicates([doc_id, hash_of]).unionByName(out.filter(F.col(hash_of) == empty))
    return out.drop(hash_of)
