"""Near-duplicate groups by HyperMinHash registers: banding, corrected estimates, and exact verification.

A document is the set of 64-bit hashes of its distinct shingles of four words; equal sets are one class, and only classes are compared.

1. *Registers.*  A shingle's hash picks one of ``REGISTERS`` buckets by its first bits; of the least hash in a bucket the number of
   leading zeros and ``MANTISSA`` bits after the first one are kept: two bytes a register, whatever the set's size.
2. *Banding.*  Empty registers borrow from others in a fixed random order, then ``BANDS`` bands of ``ROWS`` registers give keys.  At a
   similarity of 0.8 all keys differ with a chance of about ``(1 - 0.8^6)^42``, 3 in a million pairs; more similar ones far less.
3. *Pivots.*  The smallest class of a key is its pivot, found by an aggregate that combines before the shuffle, so a group of any size
   gives few pairs a member: with the ``PIVOTS`` that share most keys with it.  What a pivot links is one component already.
4. *Open keys.*  Keys that still join several components are compared whole, by one-byte codes, without pairs inside a
   component and each pair under its first common key: first each member's closest, then, between what is left apart, all.  A key of more than ``CHUNK`` classes is cut into
   chunks: its largest component meets the rest chunk by chunk, so no task holds a whole key.
5. *Estimate.*  Candidates must reach 0.8 by the share of equal registers, less the collisions that short registers make by
   chance, within a margin of one in 10^9 (an exact binomial tail over the registers that either set fills).  Registers of small sets say
   more: each unequal one holds an element that only one set has, and of those linked sets have only so many.
6. *Verification.*  Whole texts of the rest meet by pivot, split by bytes, and full sets decide.

Texts of one to three words are one shingle.  Null texts and texts without words are linked with nothing.  Ties and repeated rows share
a class.  A component is named by its smallest id; null ids sort last, and a component of null ids only is named null.  An empty table gives no rows.
Only id and text are read, so extra columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from iotlens.llm.bpe import slices
from iotlens.llm.common import hashed_words, mix, small, stored, window_hashes
from iotlens.llm.components import components

WIDTH = 4
REGISTERS = 256
MANTISSA = 10
ROWS = 6
BANDS = 42
PIVOTS = 8
NEAREST = 2
CHUNK = 4096
RISK = 1e-9
TASK_BYTES = 24_000_000
HASH_BITS = 53  # of the hash behind the bucket's bits, exact in a double


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    words, lens = hashed_words(texts, lower=True)
    windows, ends = window_hashes(words, WIDTH), np.cumsum(lens)
    out = []
    for n, end in zip(lens.tolist(), ends.tolist()):
        if n >= WIDTH:
            out.append(np.unique(windows[end - n : end - WIDTH + 1]))
        else:  # the length keeps a short text apart from the shingles of longer ones
            out.append(mix(window_hashes(words[end - n : end], n) + np.uint64(n)) if n else np.empty(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set: 0 if the bucket is empty, else leading zeros + 1, then the mantissa."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    if not lens.sum():
        return out
    flat = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)), lens) * REGISTERS + (flat >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # sets are sorted: the first of a bucket is its least
    v = (flat[first] & np.uint64((1 << 56) - 1)) >> np.uint64(56 - HASH_BITS)
    zeros = HASH_BITS - np.frexp(v.astype(np.float64))[1]
    rest = (v << (zeros + 1).astype(np.uint64)) & np.uint64((1 << HASH_BITS) - 1)
    out.reshape(-1)[place[first]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | (rest >> np.uint64(HASH_BITS - MANTISSA)).astype(np.uint16)
    return out


def filled(r: np.ndarray) -> np.ndarray:
    """Registers with empty ones borrowed: register j takes the first full one of j + step for steps in a fixed order."""
    out = r.copy()
    row, col = np.nonzero((r == 0) & r.any(1)[:, None])
    for step in np.random.default_rng(4).permutation(REGISTERS - 1) + 1:
        if not len(row):
            break
        got = r[row, (col + step) % REGISTERS]
        out[row, col] = got
        row, col = row[got == 0], col[got == 0]
    return out


def band_keys(r: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each row of filled registers."""
    deal = np.random.default_rng(13).permutation(REGISTERS)[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(r), 1))
    for k in range(ROWS):
        keys = mix(keys + r[:, deal[:, k]].astype(np.uint64) + np.uint64(k + 1))
    return keys


def codes(r: np.ndarray) -> np.ndarray:
    """One byte a register, 0 if empty; equal registers have equal codes."""
    return np.where(r == 0, 0, 1 + (r >> np.uint16(MANTISSA - 6)) % 255).astype(np.uint8)


@lru_cache(maxsize=8)
def least_equal(registers_filled: int, num: int, den: int) -> np.ndarray:
    """For each number N of registers filled, the equal ones that sets at num/den fall below with a chance of at most RISK."""
    p = num / den
    out = np.zeros(registers_filled + 1, np.int64)
    for n in range(1, registers_filled + 1):
        below, m = 0.0, 0
        while m <= n:
            below += exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * log(p) + (n - m) * log(1 - p)) if p < 1 else float(m == n)
            if below > RISK:
                break
            m += 1
        out[n] = m
    return out


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of two sets without common elements, of sizes a and b, that are expected to be equal by chance.

    The least hashes of a bucket fall at rates x and y; both fall into the same cell of level l (between 2^-l-1 and 2^-l), whose
    width is 2^-l-1-MANTISSA, with a density of x y exp(-(x + y) t) times the width.
    """
    x, y = np.maximum(a, 1) / REGISTERS, np.maximum(b, 1) / REGISTERS
    level = 2.0 ** -np.arange(HASH_BITS)[:, None]
    per_level = level / 2 * (np.exp(-(x + y) * level / 2) - np.exp(-(x + y) * level))
    return REGISTERS * 2.0**-MANTISSA * x * y / (x + y) * per_level.sum(0)


def similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers, corrected for collisions, and the registers either fills."""
    either = ((ra != 0) | (rb != 0)).sum(1)
    equal = ((ra == rb) & (ra != 0)).sum(1).astype(np.float64)
    by_chance = np.minimum(collisions(na, nb) * (either - equal) / REGISTERS, equal)
    return (equal - by_chance) / np.maximum(either, 1), either


def apart(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most elements that only one of two linked sets holds.  Every unequal register holds one, so no more registers are unequal."""
    return na + nb - 2 * -(-num * (na + nb) // (num + den))


DOCUMENT = "_id {}, _hash long, class binary, size long, registers binary"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, sizes, regs = [], [], []
        for part in slices(b.column(2).to_pylist()):
            sets = shingle_sets(part)
            names += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
            sizes += map(len, sets)
            regs += [row.tobytes() for row in registers(sets)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())],
            ["_id", "_hash", "class", "size", "registers"])


def _rows(column: pa.Array | list) -> np.ndarray:
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(raw), np.uint16).reshape(-1, REGISTERS)


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 2048):
            p = b.slice(k, 2048)
            keys = band_keys(filled(_rows(p.column(1))))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), pa.array(np.repeat(p.column(0).to_numpy(), BANDS))], ["key", "c"])


def _across(num: int, den: int, nearest: int | None):
    """Pairs of different components under one key and cell whose codes leave the threshold possible."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "cell", "size", "c"], ignore_index=True)
        rows = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(-1, REGISTERS)
        bands = np.frombuffer(b"".join(pdf["bands"]), np.uint32).reshape(-1, BANDS)
        size, c, comp = (pdf[k].to_numpy(np.int64) for k in ("size", "c", "comp"))
        key, cell = pdf["key"].to_numpy(), pdf["cell"].to_numpy()
        band = (bands == key.astype(np.int64).view(np.uint64).astype(np.uint32)[:, None]).argmax(1)
        least = least_equal(REGISTERS, num, den)
        borders = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), True])
        out = []
        for start, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
            for i in range(start, end - 1):
                stop = start + int(np.searchsorted(size[start:end], size[i] * den // num, side="right"))
                j = np.arange(i + 1, stop)
                j = j[comp[j] != comp[i]]
                if not len(j):
                    continue
                full = ((rows[j] != 0) | (rows[i] != 0)).sum(1)
                unequal = (rows[j] != rows[i]).sum(1)
                fits = (full - unequal >= least[full]) & (unequal <= apart(size[i], size[j], num, den))
                fits[fits] = (bands[j[fits], : band[i]] != bands[i, : band[i]]).all(1)  # else they meet under an earlier key
                out.append(np.column_stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), 1000 * unequal // np.maximum(full, 1)])[fits])
        pairs = pd.DataFrame(np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64), columns=["a", "b", "far"])
        if not nearest:
            return pairs
        both = pd.concat([pairs.assign(own=pairs["a"]), pairs.assign(own=pairs["b"])])
        close = both.sort_values(["own", "far", "a", "b"]).groupby("own").head(nearest)
        return close[["a", "b", "far"]].drop_duplicates()

    return run


def _verify(num: int, den: int):
    """Pairs that reach the threshold by their full sets; a pair that follows from links already found here is skipped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.drop_duplicates(["c", "_text"])
        wanted = iter(zip(texts["c"], texts["class"]))
        sets: dict[int, np.ndarray] = {}
        for part in slices(texts["_text"]):
            for s in shingle_sets(part):
                c, name = next(wanted)
                if xxhash.xxh3_128_digest(s.tobytes()) == name:  # an id may have other texts of the same hash
                    sets[c] = s
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = parent.get(up, up)
                k = up
            return k

        linked = []
        members = pdf.loc[pdf["c"] != pdf["a"], ["a", "c"]].drop_duplicates()
        for a, b in members.itertuples(index=False):
            if root(a) == root(b):
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                linked.append((a, b))
                parent[root(b)] = root(a)
        return pd.DataFrame(linked, columns=["a", "b"], dtype="int64")

    return run


def estimated(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a, b`` whose corrected estimate leaves the threshold possible."""
    left = classes.select(F.col("c").alias("a"), F.col("size").alias("na"), F.col("registers").alias("ra"))
    right = classes.select(F.col("c").alias("b"), F.col("size").alias("nb"), F.col("registers").alias("rb"))

    @F.pandas_udf("boolean")
    def possible(na: pd.Series, ra: pd.Series, nb: pd.Series, rb: pd.Series) -> pd.Series:
        a, b, sa, sb = _rows(list(ra)), _rows(list(rb)), na.to_numpy(), nb.to_numpy()
        share, either = similarity(a, b, sa, sb)
        likely = share * either >= least_equal(REGISTERS, num, den)[either] - 1  # one less: collisions are an expectation
        return pd.Series(likely & ((a != b).sum(1) <= apart(sa, sb, num, den)))

    sized = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    return pairs.join(left, "a").join(right, "b").filter(sized).filter(possible("na", "ra", "nb", "rb")).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that reach the threshold; the texts of a pivot and its members meet in pieces of about ``TASK_BYTES``."""
    possible = stored(estimated(pairs, classes, num, den), "minhash-possible")
    sizes = classes.select(F.col("c").alias("b"), F.col("bytes"))
    weighed = possible.join(sizes, "b")
    loads = weighed.groupBy("a").agg(F.sum("bytes").alias("load"))
    pieces = F.greatest(F.ceil(2 * F.col("load") / TASK_BYTES), F.lit(1))
    dealt = stored(weighed.join(loads, "a").withColumn("piece", F.pmod(F.xxhash64("b"), pieces).cast("int")).select("a", "b", "piece", "bytes"), "minhash-dealt")
    total = dealt.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, ceil(4 * total / TASK_BYTES))
    roles = dealt.select("a", F.col("b").alias("c"), "piece").unionByName(dealt.select("a", F.col("a").alias("c"), "piece").distinct())
    roles = roles.withColumn("task", F.pmod(F.xxhash64("a", "piece"), F.lit(tasks)))
    needed = roles.join(classes.select("c", "class", F.col("_id").alias("_at"), F.col("_hash").alias("_at_hash")), "c")
    texts = docs.join(needed, (docs["_hash"] == needed["_at_hash"]) & docs["_id"].eqNullSafe(needed["_at"]))
    return texts.select("task", "a", "c", "class", "_text").groupBy("task").applyInPandas(_verify(num, den), "a long, b long")


def open_cells(posts: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, cell, c, comp, size, codes, bands`` of keys that hold several components; cells cut keys of more than ``CHUNK`` classes."""
    placed = stored(posts.join(comps, posts["c"] == comps["node"], "left").select("key", "c", F.coalesce("least", "c").alias("comp")), "minhash-placed")
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("comps")).filter("comps > 1")
    keys = keys.select("key", F.col("main.comp").alias("main"), F.col("main.n").alias("in_main"), "total")
    found = stored(placed.join(keys, "key"), "minhash-open")
    whole = found.filter(F.col("total") <= CHUNK).select("key", F.lit("").alias("cell"), "c", "comp")
    cut = found.filter(F.col("total") > CHUNK)
    mains, others = F.ceil(F.col("in_main") / CHUNK).cast("int"), F.ceil((F.col("total") - F.col("in_main")) / CHUNK).cast("int")
    is_main = F.col("main") == F.col("comp")
    own = F.pmod(F.xxhash64("c"), F.when(is_main, mains).otherwise(others)).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    with_others = F.transform(every(others), lambda j: F.concat_ws("-", F.lit("m"), F.col("own"), j))
    with_mains = F.transform(every(mains), lambda i: F.concat_ws("-", F.lit("m"), i, F.col("own")))
    among = F.transform(every(others), lambda j: F.concat_ws("-", F.lit("o"), F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    split = cut.withColumn("own", own).select("key", F.explode(F.when(is_main, with_others).otherwise(F.concat(with_mains, among))).alias("cell"), "c", "comp")
    return whole.unionByName(split).join(classes.select("c", "size", "codes", "bands"), "c")


def closest(found: DataFrame, nearest: int | None) -> DataFrame:
    """Distinct pairs ``a, b``; with ``nearest`` only those that are the closest of one of their two."""
    if nearest is None:
        return found.select("a", "b").distinct()
    ends = found.select("a", "b", "far", F.col("a").alias("own")).unionByName(found.select("a", "b", "far", F.col("b").alias("own")))
    return ends.groupBy("own").agg(F.min(F.struct("far", "a", "b")).alias("m")).select("m.a", "m.b").distinct()


@F.pandas_udf(BinaryType())
def _codes(raw: pd.Series) -> pd.Series:
    return pd.Series([row.tobytes() for row in codes(_rows(list(raw)))] if len(raw) else [], dtype=object)


@F.pandas_udf(BinaryType())
def _bands(raw: pd.Series) -> pd.Series:
    """The low half of every band key."""
    return pd.Series([row.tobytes() for row in band_keys(filled(_rows(list(raw)))).astype(np.uint32)] if len(raw) else [], dtype=object)


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``_id, size, class, component_id``; threshold ``num/den``."""
    base = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    id_type = base.schema["_id"].dataType.simpleString()
    rows = stored(base.mapInArrow(_documents, DOCUMENT.format(id_type)), "minhash-documents")
    # One row stands for a class, found by id and hash of the text, as ids may repeat or be null.
    at = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "size", "registers")).alias("at")
    classes = rows.filter(F.col("size") > 0).groupBy("class").agg(at).select(
        F.monotonically_increasing_id().alias("c"), "class", "at._id", "at._hash", "at.size", "at.registers")
    classes = stored(classes.withColumn("codes", _codes("registers")).withColumn("bands", _bands("registers")).withColumn("bytes", 8 * F.col("size")), "minhash-classes")
    posts = stored(classes.select("c", "registers").mapInArrow(_posts, "key long, c long"), "minhash-posts")
    shared = posts.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a != z").select("key", "a")
    star = posts.join(shared, "key").filter(F.col("a") != F.col("c")).groupBy("c", "a").agg(F.count("*").alias("n"))
    most_shared = F.slice(F.sort_array(F.collect_list(F.struct("n", "a")), asc=False), 1, PIVOTS)  # a class has at most BANDS pivots
    pairs = stored(star.groupBy("c").agg(most_shared.alias("m")).select(F.explode("m.a").alias("a"), F.col("c").alias("b")), "minhash-pairs")
    edges = stored(links(base, classes, pairs, num, den), "minhash-links")
    tested, comps = pairs, components(edges, "minhash-edges")
    for nearest in (NEAREST, None):
        cells = open_cells(posts, comps, classes)
        tasks = max(8, ceil(cells.count() / 50_000))
        bucket = F.pmod(F.xxhash64("key", "cell"), F.lit(tasks)).alias("bucket")
        found = cells.groupBy(bucket).applyInPandas(_across(num, den, nearest), "a long, b long, far long")
        more = stored(closest(found, nearest).join(tested, ["a", "b"], "left_anti"), "minhash-more")
        if not more.isEmpty():
            edges = edges.unionByName(stored(links(base, classes, more, num, den), "minhash-links"))
            comps = components(edges, "minhash-edges")
            tested = tested.unionByName(more)
    placed = stored(classes.join(comps, classes["c"] == comps["node"], "left").select("class", "_id", F.coalesce("least", "c").alias("comp")), "minhash-named")
    names = small(placed.groupBy("comp").agg(F.min("_id").alias("component_id")), "minhash-names")
    named = stored(placed.select("class", "comp").join(names, "comp").select("class", "component_id"), "minhash-components")
    return rows.select("_id", "size", "class").join(named, "class", "left").select(
        "_id", "size", "class", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    return labelled(docs, doc_id, text, num, den).select(
        F.col("_id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
