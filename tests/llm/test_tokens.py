"""Tables of workers: bounded, and the pieces that are asked for again stay in them."""

from __future__ import annotations

import re
import sys

import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from pdwatch.llm import packing, tokens
from pdwatch.llm.tokens import PieceEncoder, Remembered

TEXTS = [
    "it's The plain text, the 'st'll-known (re)port's; don't 12345 a1b2 x" + " word" * 5,
    "Größe überall, naïve  café\n\n\ttabs  and   spaces <|endoftext|> é\x00ß",
    *[f"item{n} costs {n * n}$, isn't it? ({n})'s" for n in range(300)],
]


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_small_table_gives_the_ids_of_the_tokenizer(name, keeps_space):
    path = public_tokenizers.path(name)
    plain, encoder = Tokenizer.from_file(path), PieceEncoder(path, keeps_space, most=7)
    for text in TEXTS:
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder) <= 7 and len(encoder.older) <= 7


def test_pieces_asked_for_again_are_not_encoded_again():
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True, most=50)
    made, of_word = [], encoder.of_word
    encoder.of_word = lambda word: made.append(word) or of_word(word)
    for n in range(1000):
        encoder.encode(f"a common word and w{n:03}x")
    assert [made.count(word) for word in ("a", " common", " word", " and")] == [1, 1, 1, 1]


def test_the_older_entries_go_when_the_table_is_full():
    table = Remembered(2)
    for key in "abcde":
        table.keep(key, key.encode())
    assert list(table) == ["e"] and list(table.older) == ["c", "d"]


def test_a_worker_of_packing_holds_few_rows_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([Row(doc_id=n, text=f"text {n}") for n in range(2500)]).coalesce(1)
    whole = {tuple(r) for r in packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), True).collect()}
    assert packing.HELD_ROWS < 2500 and len({r[0] for r in whole}) == 2500
    monkeypatch.setattr(packing, "HELD_ROWS", 7)
    assert {tuple(r) for r in packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), True).collect()} == whole
    assert tokens.CACHE_ENTRIES * 2 < 1_000_000


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_of_letters_alone_are_not_cut(name, keeps_space):
    path = public_tokenizers.path(name)
    plain, encoder = Tokenizer.from_file(path), PieceEncoder(path, keeps_space)
    cut, find = [], encoder.find
    encoder.find = lambda piece: cut.append(piece) or find(piece)
    text = "Plain Wörter ÀÉß été über, it's\nOnly ÿ word's"
    assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert cut and not any(piece.strip().isalpha() for piece in cut)


def test_texts_without_rare_characters_are_not_searched(monkeypatch):
    class Searched:
        def search(self, text):
            raise AssertionError(text)

    assert not any(chr(n).isprintable() for n in range(sys.maxunicode) if n != 32 and re.match(r"\s|\0", chr(n)))
    monkeypatch.setattr(tokens, "_TWO_SPACES", Searched())
    assert tokens.spaced_pieces("a bc\nd é") == ["a", " bc", "\n", "d", " é"]


def test_a_full_table_takes_no_more_space_than_its_power_of_two():
    table = dict.fromkeys(map(str, range(1 << 18)))
    space = sys.getsizeof(table)
    table.update(dict.fromkeys(map(str, range(tokens.CACHE_ENTRIES))))
    assert len(table) == tokens.CACHE_ENTRIES > 1 << 18 and sys.getsizeof(table) == space
