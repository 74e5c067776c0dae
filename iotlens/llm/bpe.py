"""Byte-level BPE over a public tokenizer file: encoding by a pair occurrence index, and decoding.

The new pre-tokens of a batch are laid out as one chain of byte symbols.  An index maps each adjacent
pair that has a merge rank to all its positions.  Ranks are taken in ascending order; a rank's positions
are merged together, and only the lists of the pairs left and right of each merge are extended.  A
position that an earlier merge has consumed is recognised by its symbols and skipped.

Null and empty texts have no ids and decode to the empty text.  Pre-tokens already encoded in the same
task are looked up; the store is emptied at ``max_words``, so memory is bounded whatever the corpus.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from re import Pattern
from types import ModuleType

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pre-token pattern of byte-level BPE, with white space spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NARROW = 0x250


def _pre(engine: ModuleType, letters: str, numbers: str) -> Pattern:
    return engine.compile(
        rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+"
        rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def narrow(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(_NARROW) if unicodedata.category(chr(c)).startswith(kind))


# The same pattern twice: texts of Latin letters only take the standard library, which is faster.
_ANY = _pre(regex, r"\p{L}", r"\p{N}")
_LATIN = _pre(re, narrow("L"), narrow("N"))
WIDE = re.compile(f"[^\\x00-\\u{_NARROW - 1:04x}]")


def _pre_tokens(text: str) -> list[str]:
    return (_ANY if WIDE.search(text) else _LATIN).findall(text)


def byte_alphabet() -> dict[str, int]:
    """Printable character of each byte: itself where it prints, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Slots(dict):
    """Number of each word, in order of first sight; ``new`` lists the words not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.used = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = self.used
        self.used += 1
        self.new.append(word)
        return n


class Store:
    """Growing flat array of the items of numbered entries."""

    def __init__(self) -> None:
        self.items = np.empty(1 << 16, np.int32)
        self.starts = np.empty(1 << 12, np.int64)
        self.lens = np.empty(1 << 12, np.int64)
        self.used = self.n = 0

    def add(self, items: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(items) > len(self.items):
            self.items = np.concatenate([self.items, np.empty_like(self.items)])
        while self.n + len(lens) > len(self.lens):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.empty_like(self.lens)])
        self.items[self.used : self.used + len(items)] = items
        self.starts[self.n : self.n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : self.n + len(lens)] = lens
        self.used += len(items)
        self.n += len(lens)


def gather(items: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``items[start:start+len]`` one after another."""
    ends = np.cumsum(lens)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)
    return items[at]


class ByteBpe:
    """One tokenizer file, ready to encode and decode batches of texts."""

    def __init__(self, path: str, max_words: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        size = max(names.values()) + 1
        raw = [b""] * size
        for token, i in names.items():
            raw[i] = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
        self.text_of = np.frombuffer(b"".join(raw), np.uint8)
        self.text_lens = np.fromiter(map(len, raw), np.int64, size)
        self.text_starts = np.cumsum(self.text_lens) - self.text_lens
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        self.left, self.right = left, right
        self.made = np.fromiter((vocab[a + b] for a, b in pairs), np.int32, len(pairs))
        keys = (left << 20) | right
        self.rank_order = np.argsort(keys, kind="stable")
        self.sorted_keys = keys[self.rank_order]
        self.decimal = [str(i) for i in range(size)]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.slots = Slots()
        self.store = Store()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where it has none."""
        keys = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where((self.sorted_keys[at] == keys) & (a >= 0) & (b >= 0), self.rank_order[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1]) + 1 if len(raw) else 1
        symbol = np.full(n, -1, np.int32)  # -1 stands before, between and behind the words
        inside = np.ones(n, bool)
        inside[0] = False
        inside[ends] = False
        symbol[inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            at, ranks = at[known], ranks[known]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(part)

        enter(np.arange(n - 1), self._ranks(symbol[:-1], symbol[1:]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            at = at[symbol[at] == a]
            follower = after[at]
            fits = symbol[follower] == b
            at, follower = at[fits], follower[fits]
            if a == b and len(at) > 1:  # overlapping pairs: from the left, none twice
                taken, last = np.zeros(len(at), bool), -1
                for k, (p, q) in enumerate(zip(at.tolist(), follower.tolist())):
                    if p != last:
                        taken[k], last = True, q
                at, follower = at[taken], follower[taken]
            if not len(at):
                continue
            behind = after[follower]
            symbol[at] = self.made[rank]
            symbol[follower] = -2
            after[at] = behind
            before[behind] = at
            ahead = before[at]
            enter(np.concatenate([ahead, at]), self._ranks(
                np.concatenate([symbol[ahead], symbol[at]]), np.concatenate([symbol[at], symbol[behind]])))
        left = symbol != -2
        kept = symbol[left]
        marks = np.flatnonzero(kept == -1)
        return kept[kept >= 0], np.diff(marks) - 1

    def _learn(self) -> None:
        """Encodes the words seen for the first time."""
        new, self.slots.new = self.slots.new, []
        if not new:
            return
        special = {k: self.special[w[8:]] for k, w in enumerate(new) if w[0] == "\0" and w[1:8] == "special" and w[8:] in self.special}
        ids, lens = self.encode_words(["" if k in special else w for k, w in enumerate(new)] if special else new)
        if special:
            at = np.fromiter(special, np.int64, len(special))
            ids = np.insert(ids, (np.cumsum(lens) - lens)[at], list(special.values()))
            lens[at] = 1
        self.store.add(ids, lens)

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.split is None or "<|" not in text:
            return _pre_tokens(text)
        out, last = [], 0
        for m in self.split.finditer(text):
            out += _pre_tokens(text[last : m.start()])
            out.append("\0special" + m[0])
            last = m.end()
        return out + _pre_tokens(text[last:])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        if len(self.slots) > self.max_words:
            self._reset()
        lists = [self.pieces(t) for t in texts]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(lists)), np.int64, int(lens.sum()))
        self._learn()
        sizes = self.store.lens[slots]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(lens)
        return gather(self.store.items, self.store.starts[slots], sizes), sums[ends] - sums[ends - lens]

    def decode_batch(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """The texts of id sequences that lie one after another; broken UTF-8 is replaced."""
        sizes = self.text_lens[ids]
        raw = gather(self.text_of, self.text_starts[ids], sizes).tobytes()
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(lens)
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip(sums[ends - lens].tolist(), sums[ends].tolist())]


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def slices(texts: pd.Series, chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """A batch in pieces of at least one text and about ``chars`` characters."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` (array of int) in column ``ids``."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            out: list[np.ndarray] = []
            for part in slices(batch):
                flat, lens = own.encode_batch(part)
                out += np.split(flat, np.cumsum(lens)[:-1])
            yield pd.Series(out, index=batch.index, dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids; null ids count as none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            lists = [np.asarray(x if x is not None else [], np.int64) for x in batch]
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pd.Series(own.decode_batch(flat, lens), index=batch.index, dtype=object)

    return df.withColumn(text, run(F.col(ids)))


DIGEST = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def digest(path: str, text: Column) -> Column:
    """Token count and digests of the ids and of the text decoded from them, one pass per batch."""

    @F.pandas_udf(DIGEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            rows = []
            for part in slices(batch):
                flat, lens = own.encode_batch(part)
                decoded = own.decode_batch(flat, lens)
                words = list(map(own.decimal.__getitem__, flat.tolist()))
                start = 0
                for n, back in zip(lens.tolist(), decoded):
                    ids = ",".join(words[start : start + n]).encode()
                    rows.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                    start += n
            yield pd.DataFrame(rows, columns=DIGEST.names)

    return run(text)
