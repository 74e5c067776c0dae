"""Token files cut and encode each distinct word of a group of texts once, and give the library's ids."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from iotlens.llm import tokenfile

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\r\n\t\x0b\x0c a", " lead  trail ", "don't <|endoftext|> stop", "a<|startoftext|>b <|x|> |<|", "日本 語 🙂", "a\x1cb\x85c\xa0d \x1f",
    "é̸ ÀÉ", "ΟΔΟΣ ΟΔΟΣ Σ", "İstanbul ISI ıIİ", "é ́x a ̀", "‘quoted’ it’s “x”", "ẞ Ǆ ﬁ Å 가 각", "½² 1234 x1y2", "x" * 3000, "﻿​ a b",
]


def encoded(own: tokenfile.Tokens, texts: list[str | None], size: int, block: int) -> tuple[list[list[int]], int]:
    pieces = [p for t in tokenfile.groups(pa.array(texts, pa.string()), size) for p in own.encode(t, block)]
    return [x.tolist() for ids, lens in pieces for x in np.split(ids, np.cumsum(lens)[:-1])], len(pieces)


@pytest.mark.parametrize("size, block", [(1, 1), (30, 4), (1 << 24, 3), (1 << 24, 1 << 18)])
def test_ids_are_the_library_s(size, block):
    own, lib = tokenfile.Tokens(WORDS, max_pieces=40), Tokenizer.from_file(WORDS)
    texts = ODD + ["word Word wOrd, (word)"] * 5 + ODD[::-1]
    got, pieces = encoded(own, texts, size, block)
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert pieces == 1 if block == 1 << 18 else pieces > 5


def test_each_distinct_word_is_met_once(monkeypatch):
    cut, whole, real = [], [], tokenfile._PRE

    class Spy:
        def findall(self, lines):
            cut.append(lines)
            return real.findall(lines)

    own = tokenfile.Tokens(WORDS)
    library = own.tokenizer

    class Library:
        def encode_batch_fast(self, texts, add_special_tokens):
            whole.extend(texts)
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(tokenfile, "_PRE", Spy())
    own.tokenizer = Library()
    text = " ".join(["Über don't 42 it’s <|endoftext|>"] * 500)
    got, _ = encoded(own, [text] * 4, 1 << 24, 1 << 18)
    assert got == [library.encode(text, add_special_tokens=False).ids] * 4
    assert cut == ["über\ndon't\n42\n\n\n"] and whole == ["it’s", "<|endoftext|>"]


def test_usual_words_stay_known_when_the_store_is_full():
    own = tokenfile.Tokens(WORDS, max_pieces=12)
    model, new = own.model, []

    class Model:
        def tokenize(self, shown):
            new.append(shown)
            return model.tokenize(shown)

    own.model = Model()
    for k in range(20):
        encoded(own, ["the, (the) the. " + " ".join(f"{chr(97 + k)}{chr(97 + j)}" for j in range(8))], 1 << 24, 1)
    assert new.count("the") == 1 and len(own.slots) < 40


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokenfile.Tokens(BYTES)
