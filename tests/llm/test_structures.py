"""The structures behind the text operators, against plain definitions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from pdwatch.llm import wavelet  # noqa: E402
from pdwatch.llm.packing import binary_lengths  # noqa: E402
from pdwatch.llm.sharding import communication_matrix  # noqa: E402
from pdwatch.llm.suffix_array import common_prefixes, suffix_array  # noqa: E402
from pdwatch.llm.tokens import encoder  # noqa: E402
from pdwatch.llm.wavelet import WaveletMatrix  # noqa: E402


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_sorts_suffixes(symbols):
    order = suffix_array(np.array(symbols, np.int64))
    assert order.tolist() == sorted(range(len(symbols)), key=lambda start: symbols[start:])
    shared = common_prefixes(np.array(symbols, np.int64), order)
    for place in range(1, len(symbols)):
        a, b = symbols[order[place - 1] :], symbols[order[place] :]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert shared[place] == same


@pytest.mark.parametrize("size", [0, 1, 7, 4089, 4095, 4096, 4097, 9001])
def test_wavelet_matrix_round_trip(size):
    rng = np.random.default_rng(size)
    ids = (rng.zipf(1.4, size) % 300).astype(np.uint16)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.from_ids(ids).to_bytes())
    assert matrix.ids().tolist() == ids.tolist()
    for position in range(0, size, max(1, size // 11)):
        assert matrix.access(position) == ids[position]
    for token in {*ids[:5].tolist(), 301}:
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.rank(token, size // 2) == int((places < size // 2).sum())
        for number in range(0, len(places), max(1, len(places) // 7)):
            assert matrix.select(token, number) == places[number]
        assert matrix.select(token, len(places)) == -1


def test_wavelet_file_is_compressed_and_reads_its_own_directory(monkeypatch):
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.6, 200_000) % 5000).astype(np.uint16)
    whole = WaveletMatrix.from_ids(ids)
    data = whole.to_bytes()
    assert len(data) < 0.8 * sum(plane.nbytes for plane in whole.planes)
    # Opening a file counts nothing, and a bit is read without unpacking the planes below.
    monkeypatch.setattr(wavelet, "_block_ranks", None)
    matrix = WaveletMatrix.from_bytes(data)
    assert all(isinstance(plane, bytes) for plane in matrix.planes)
    assert matrix._ones(0, 150_000) == whole._ones(0, 150_000)
    assert [isinstance(plane, bytes) for plane in matrix.planes] == [False] + [True] * (len(matrix.planes) - 1)
    places = np.flatnonzero(ids == 3)
    assert matrix.count(3) == len(places) and matrix.select(3, len(places) // 2) == places[len(places) // 2]
    assert matrix.to_bytes() == data and matrix.ids().tolist() == ids.tolist()


TEXTS = [
    "", " ", "\n", "a", "  a  b ", "a\n\n b \n c", "x  y <|endoftext|> z<|endoftext|>", "İstanbul ΣΑΣ é é",
    "\x1c a\x1f b \x85 c\t d", "don't  we'll\n\n\n", "a " * 50, "\0 x \0", " lead", "trail \n", "€5,000.00 – ‘quote’ ÷×",
    "word" * 40, "日本語 テキスト", "1234567 12 3",
]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piece_encoder_equals_tokenizer(name, keeps):
    found = encoder(public_tokenizers.path(name), keeps)
    for text in TEXTS:
        assert found.encode(text).tolist() == found.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@given(st.integers(1, 10_000))
def test_binary_lengths(tokens):
    lengths = binary_lengths(tokens, 2048)
    assert sum(lengths) == tokens
    assert all(length <= 2048 and length & (length - 1) == 0 for length in lengths)
    assert sorted(lengths, reverse=True) == lengths


def test_communication_matrix_has_exact_margins_and_expected_means():
    partitions, shards = [50, 0, 7, 43], [34, 33, 33]
    total = np.zeros((4, 3))
    for seed in range(400):
        matrix = np.array(communication_matrix(partitions, shards, seed))
        assert matrix.sum(1).tolist() == partitions
        assert matrix.sum(0).tolist() == shards
        total += matrix
    assert np.abs(total / 400 - np.outer(partitions, shards) / 100).max() < 0.5
