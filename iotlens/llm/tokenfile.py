"""Token-id files: blocks of documents compressed by a range asymmetric numeral system (rANS).

*Format.*  A file holds blocks, one row each (Parquet is the container, so any store that Spark reads will do): position in
the corpus, document ids and lengths, and a payload.  The ids of a block are dealt to ``LANES`` interleaved coders that
share one static frequency table, counted over the whole corpus and stored beside the blocks.  A payload starts with the
coders' states at its checkpoints, each with its place in the word stream, so the stretches between checkpoints decode
independently and in parallel; a checksum covers the payload and another the decoded ids.

*Writing.*  Documents are spread by range of their id and sorted, each task tokenizes its range and packs whole documents into blocks of about
``BLOCK`` ids.  The pass that packs also counts the ids of each block, a second one encodes, so texts are tokenized
once.  Blocks of a file ascend in document id; ``part, block`` order all blocks.

Null and empty texts have the end id only.  Null document ids come first.  Rows with equal ids are separate documents,
ordered by a hash of their text; equal rows are interchangeable.  An empty table gives no blocks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from iotlens.llm.bpe import SPACE, WIDE, Slots, Store, byte_alphabet, gather, narrow
from iotlens.llm.common import crc, scratch, small, stored

LANES = 2048
BLOCK = 1 << 19
BITS = 18
STRETCHES = 2
LOW = np.uint64(1 << 31)
SHIFT = np.uint64(BITS)
MASK = np.uint64((1 << BITS) - 1)
ONE, GOAL = np.uint64(1), np.uint64(1 << BITS)
WORD_BITS = np.uint64(32)

# The tokenizer's own steps before its model, and its pre-token pattern for lower-cased words of Latin letters, one a line.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_L, _N = narrow("L"), narrow("N")
_PRE = re.compile(rf"[{_L}]+|\n|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{SPACE}{_L}{_N}]+")
_BYTES = {b: c for c, b in byte_alphabet().items() if b != 0x0A}  # white space is in no pre-token


class Tokens:
    """The library's tokenizer, its steps run once for each distinct word of a group of texts.

    No token reaches over white space, so a text's ids are those of its words between ASCII white space.  Words of Latin letters
    are cut into pre-tokens here; those already met in the task are looked up, the library's model encodes the new ones.  Words
    with other letters or special tokens go to the library whole.
    """

    def __init__(self, path: str, max_pieces: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        if (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"]) != (_NORMALIZER, _SPLITS, None):
            raise ValueError("the tokenizer's steps before its model aren't those that are known here")
        if any(re.search(rf"[{SPACE}]", t["content"]) or not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("a special token has white space or another beginning than <|")
        self.model = self.tokenizer.model
        self.max_pieces = max_pieces
        self._reset()

    def _reset(self) -> None:
        self.slots, self.store = Slots(), Store()
        self.slots["\n"] = 0  # the end of a word
        self.slots.used = 1
        self.store.add(np.empty(0, np.int32), np.zeros(1, np.int64))
        self.met = np.zeros(1, np.int64)

    def _trim(self) -> None:
        """Keeps the half of the pre-tokens that stand in most words, so that the usual ones aren't encoded again."""
        words, store = list(self.slots), self.store
        best = np.argsort(-self.met[1:], kind="stable")[: self.max_pieces // 2] + 1
        met = self.met
        self._reset()
        kept = np.sort(best[np.cumsum(store.lens[best]) <= 20 * self.max_pieces])
        self.slots.update(zip(map(words.__getitem__, kept.tolist()), range(1, len(kept) + 1)))
        self.slots.used = len(kept) + 1
        self.store.add(gather(store.items, store.starts[kept], store.lens[kept]), store.lens[kept])
        self.met = np.concatenate([[0], met[kept] // 2])

    def _learn(self) -> None:
        new, self.slots.new = self.slots.new, []
        if not new:
            return
        ids: list[int] = []
        ends: list[int] = []
        for shown in "\n".join(new).encode().decode("latin-1").translate(_BYTES).split("\n"):
            ids += [t.id for t in self.model.tokenize(shown)]
            ends.append(len(ids))
        self.store.add(np.array(ids, np.int32), np.diff(ends, prepend=0))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word the start and number of its own."""
        if len(self.slots) > self.max_pieces or self.store.used > 40 * self.max_pieces:
            self._trim()
        lines, whole = "\n".join([*words, ""]), []
        if "<|" in lines or WIDE.search(lines):
            whole = [k for k, w in enumerate(words) if "<|" in w or WIDE.search(w)]
            narrowed = list(words)
            for k in whole:
                narrowed[k] = ""
            lines = "\n".join([*narrowed, ""])
        pieces = _PRE.findall(lines.lower())
        slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        met = np.bincount(slots, minlength=self.store.n)
        met[: len(self.met)] += self.met
        self.met = met
        sizes = self.store.lens[slots]
        ids = gather(self.store.items, self.store.starts[slots], sizes)
        ends = np.cumsum(sizes)[slots == 0]
        starts, lens = np.concatenate([[0], ends[:-1]]) if len(ends) else ends, np.diff(ends, prepend=0)
        if whole:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in whole], add_special_tokens=False)]
            lens[whole] = [len(f) for f in found]
            starts[whole] = len(ids) + np.cumsum(lens[whole]) - lens[whole]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.int32)])
        return ids, starts, lens

    def encode(self, texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts in order, and how many each text has, in pieces of whole texts with at least ``block`` ids, but for the last."""
        lists = pc.ascii_split_whitespace(texts)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids, starts, lens = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy()
        ends = np.cumsum(counts)
        sums = np.concatenate([[0], np.cumsum(lens[codes])[ends[ends > 0] - 1]])  # ids before each text
        sums = np.concatenate([np.zeros(len(ends) + 1 - len(sums), np.int64), sums])
        first = at = 0
        while first < len(counts):
            last = min(int(np.searchsorted(sums, sums[first] + block)), len(counts))
            own = codes[at : ends[last - 1]]
            yield gather(ids, starts[own], lens[own]), np.diff(sums[first : last + 1])
            first, at = last, int(ends[last - 1])


def groups(texts: pa.Array, size: int = 3 << 23) -> Iterator[pa.Array]:
    """A batch's texts in slices of at least one text and about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = at = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, at + size)))
        yield texts.slice(first, last - first)
        first, at = last, int(ends[last - 1])


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2**BITS``, at least 1 for every id that occurs."""
    total = counts.sum()
    if not total:
        return np.zeros(len(counts), np.int64)
    goal = 1 << BITS
    freq = np.where(counts > 0, np.maximum(1, counts * goal // total), 0)
    rest = goal - int(freq.sum())
    if rest >= 0:
        freq[int(np.argmax(freq))] += rest
        return freq
    order = np.argsort(-freq, kind="stable")
    for k in order.tolist():  # take back what the minimum of 1 has added, from the largest
        take = min(-rest, int(freq[k] // 2))
        freq[k] -= take
        rest += take
        if not rest:
            break
    return freq


class Coder:
    """Interleaved rANS with one static table: 64-bit states, 32-bit words."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        # What a slot of the table decodes to, in one number: its id, the id's frequency less 1, and the place among the id's slots.
        ids = np.repeat(np.arange(len(freq), dtype=np.uint64), freq)
        place = np.arange(len(ids), dtype=np.uint64) - self.start[ids.astype(np.int64)]
        self.slots = (ids << (SHIFT + SHIFT)) | ((self.freq[ids.astype(np.int64)] - ONE) << SHIFT) | place

    def encode(self, ids: np.ndarray, lanes: int = LANES, stretches: int = STRETCHES) -> bytes:
        n = len(ids)
        steps = -(-n // lanes)
        rows = np.full(steps * lanes, ids[-1] if n else 0, np.int64)  # the last step is filled up
        rows[:n] = ids
        rows = rows.reshape(steps, lanes)
        cuts = sorted({steps * k // stretches for k in range(stretches)}) if steps else []
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        points: dict[int, np.ndarray] = {}
        sizes = np.zeros(steps + 1, np.int64)
        freqs, starts = self.freq.take(rows), self.start.take(rows)
        turns = np.empty(lanes, np.uint64)
        for t in range(steps - 1, -1, -1):
            f = freqs[t]
            full = np.flatnonzero(state >= f << np.uint64(63 - BITS))
            out = state.take(full)
            words.append(out.astype("<u4"))  # the low half
            sizes[t] = len(out)
            state[full] = out >> WORD_BITS
            np.floor_divide(state, f, out=turns)
            turns *= GOAL - f  # state becomes (turns << BITS) + (state - turns * f) + start
            state += turns
            state += starts[t]
            if t in cuts:
                points[t] = state.copy()
        places = np.concatenate([[0], np.cumsum(sizes[:-1])]) if steps else np.zeros(1, np.int64)
        head = np.array([n, lanes, len(cuts), *(x for t in cuts for x in (t, places[t]))], "<u8")
        body = [points[t].astype("<u8").tobytes() for t in cuts] + [w.tobytes() for w in reversed(words)]
        payload = head.tobytes() + b"".join(body)
        return np.array([crc(payload)], "<u4").tobytes() + payload

    def stretches(self, payload: bytes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first step, last step, states, words)`` of each independent stretch; raises if the checksum is wrong."""
        if crc(payload[4:]) != int.from_bytes(payload[:4], "little"):
            raise ValueError("token block: wrong checksum")
        n, lanes, count = (int(x) for x in np.frombuffer(payload, "<u8", 3, 4))
        steps = -(-n // lanes) if lanes else 0
        marks = np.frombuffer(payload, "<u8", 2 * count, 28).astype(np.int64).reshape(-1, 2)
        at = 28 + 16 * count
        states = np.frombuffer(payload, "<u8", count * lanes, at).reshape(count, lanes)
        words = np.frombuffer(payload, "<u4", -1, at + 8 * count * lanes)
        ends = [*marks[1:, 0].tolist(), steps]
        places = [*marks[1:, 1].tolist(), len(words)]
        return [(int(t), end, states[k], words[int(p):place]) for k, ((t, p), end, place) in enumerate(zip(marks, ends, places))]

    def decode_stretch(self, first: int, last: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        state = states.astype(np.uint64)
        out = np.empty((last - first, len(state)), np.uint32)
        at = 0
        for t in range(last - first):
            met = self.slots.take((state & MASK).view(np.int64))
            out[t] = met >> (SHIFT + SHIFT)
            state >>= SHIFT
            state *= ((met >> SHIFT) & MASK) + ONE
            state += met & MASK
            low = np.flatnonzero(state < LOW)
            n = len(low)
            state[low] = (state.take(low) << WORD_BITS) | words[at : at + n]
            at += n
        return out.reshape(-1)

    def decode(self, payload: bytes) -> np.ndarray:
        n = int(np.frombuffer(payload, "<u8", 1, 4)[0])
        parts = [self.decode_stretch(*s) for s in self.stretches(payload)]
        return np.concatenate(parts)[:n] if parts else np.empty(0, np.uint32)


PACKED = "part int, block int, first long, n_ids long, doc_ids array<{id}>, lens array<int>, ids binary, used array<int>, counts array<int>"


def _width(vocabulary: int) -> str:
    """Ids between the two passes take two bytes where the vocabulary lets them."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _pack(path: str, end_id: int, block: int, id_type: pa.DataType, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = tokens(path), TaskContext.get().partitionId()
        number = first = 0
        doc_ids: list = []
        lens: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal number, first, held
            every = np.concatenate(ids)
            counts = np.bincount(every)
            used = np.flatnonzero(counts)
            row = [[part], [number], [first], [held], [doc_ids[:]], [np.concatenate(lens)], [every.astype(width).tobytes()], [used], [counts[used]]]
            whole = pa.list_(pa.int32())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), whole, pa.binary(), whole, whole)
            names = ["part", "block", "first", "n_ids", "doc_ids", "lens", "ids", "used", "counts"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names)
            number, first, held = number + 1, first + held, 0
            doc_ids.clear(), lens.clear(), ids.clear()
            return batch

        for b in batches:
            keys = b.column(0).to_pylist()
            done = 0
            for flat, n in chain.from_iterable(own.encode(t, block) for t in groups(b.column(1))):
                flat = np.insert(flat, np.cumsum(n), end_id)
                doc_ids += keys[done : done + len(n)]
                done += len(n)
                lens.append((n + 1).astype(np.int32))
                ids.append(flat)
                held += len(flat)
                if held >= block:
                    yield out()
        if held:
            yield out()

    return run


def _count(size: int):
    """Sums the counts of a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            # An id is there once a block, and several times in a batch of blocks.
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Writes the blocks to ``path/blocks`` and the frequency table to ``path/table``."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    width = _width(vocabulary)
    named = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    sorted_docs = named.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_hash").select("_id", "_text")
    packed = stored(sorted_docs.mapInArrow(_pack(tokenizer, end_id, block, to_arrow_type(id_type), width), PACKED.format(id=id_type.simpleString())), "token-ids")
    counted = packed.select("used", "counts").mapInArrow(_count(vocabulary), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted.coalesce(1).write.parquet(f"{path}/table")  # one row per id of the vocabulary
    coder = load_coder(spark, path, vocabulary)
    # One row per task of the first pass: ids before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = packed.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = packed.join(small(bases, "token-bases"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder.value
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_py(), width).astype("<u4")
                payload = own.encode(ids)
                kept = [row.column(c) for c in ("part", "block", "start", "n_ids", "doc_ids", "lens")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([payload], pa.binary()), pa.array([crc(ids.tobytes())], pa.int64())], BLOCKS)

    rows = placed.select("part", "block", (F.col("base") + F.col("first")).alias("start"), "n_ids", "doc_ids", "lens", "ids")
    kind = f"part int, block int, start long, n_ids long, doc_ids array<{id_type.simpleString()}>, lens array<int>, payload binary, ids_crc long"
    encoded = rows.mapInArrow(run, kind).sortWithinPartitions("part", "block")
    encoded.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


BLOCKS = ["part", "block", "start", "n_ids", "doc_ids", "lens", "payload", "ids_crc"]


def load_coder(spark: SparkSession, path: str, vocabulary: int):
    """The table's coder as a broadcast of at most ``2**BITS`` slots."""
    counts = np.zeros(vocabulary, np.int64)
    for r in spark.read.parquet(f"{path}/table").collect():
        counts[r["id"]] = r["n"]
    return spark.sparkContext.broadcast(Coder(normalise(counts)))


def read(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit integers) of every document in the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    coder = load_coder(spark, path, vocabulary)
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder.value
        for b in batches:
            for k in range(b.num_rows):
                start, docs, lens, payload, check = (b.column(c)[k] for c in range(5))
                raw = own.decode(payload.as_py()).astype("<u4").tobytes()
                if crc(raw) != check.as_py():
                    raise ValueError("token block: decoded ids have another checksum")
                n = np.asarray(lens.as_py(), np.int64)
                ends = np.cumsum(n)
                ids = [raw[4 * s : 4 * e] for s, e in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start.as_py() + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("start", "doc_ids", "lens", "payload", "ids_crc").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Writes ``docs`` to the shared folder, reads the files back, and gives ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write(docs, path, tokenizer, end_id, vocabulary)
    return read(spark, path, vocabulary).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
