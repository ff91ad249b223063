"""Tokenizer alignment against plain pairs, and the piece encoders against whole encodings."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from pdwatch.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """All columns of each row, from whole encodings and all pairs."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in printable}
    byte_of |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}
    docs, count = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
            pieces = [b.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                members = defaultdict(lambda: ([], []))
                for side, (ids, ends) in enumerate([(ids_a, ends_a), (ids_b, ends_b)]):
                    for i, end in zip(ids, ends, strict=True):
                        members[next(c for c in common if c >= end)][side].append(i)
                groups = [members[c] for c in common]
        links = [(x, y) for group in groups for x in group[0] for y in group[1]]
        count.update(set(links))
        docs.append((doc_id, groups, links))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, groups, links in docs:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
             sum(count[x] == highest[x[0]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(written.encode()).hexdigest() if groups else "")
        )
    return sorted(out, key=repr)


def _rows():
    rng = np.random.default_rng(4)
    words = ["the", "of", "onhere", "tionanon", "strasse", "Über", "naïve", "\n", "\t", " ", "  ", "x" * 70, "12345", "日本語", "テ", "🙂", "<s>",
             "<|endoftext|>", "</s>", "don't", "é", " ", "\0", "a.b,c", "<0x41>", "A"]
    rows = [(n, " ".join(words[k] for k in rng.integers(0, len(words), int(rng.integers(1, 60))))) for n in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "a "), (105, "▁x y"), (106, "x ▁"), (None, "the of the")]
    rows += [(None, "the of the"), (3, "other text"), (107, "the of " * 3000), (108, "q" * 5000), (109, "<unk> �"), (110, "🙂" * 300)]
    return rows


def test_pieces_equal_whole_encodings():
    t = alignment.Tokenizers(A, B)
    whole = SentencePieceProcessor(model_file=B)
    assert t.divisible
    rng = np.random.default_rng(8)
    alphabet = list("abc  \n\té日🙂.,'0▁\0<>") + ["the ", " of", "<s>"]
    for _ in range(3000):
        text = "".join(alphabet[n] for n in rng.integers(0, len(alphabet), int(rng.integers(1, 25))))
        assert t.encode_b(text).tolist() == whole.encode(text), text


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 5, 0])
def test_documents_equal_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    monkeypatch.setattr(alignment, "_HELD_BYTES", 500)
    rows = _rows()
    docs = spark.createDataFrame([(i, x, 1, 2, "c") for i, x in rows], "doc_id bigint, text string, n bigint, part int, a string")
    found = sorted(map(tuple, alignment.align_tokenizers(docs.repartition(3), A, B).collect()), key=repr)
    assert found == plain(rows)


def test_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id bigint, text string"), A, B).collect() == []
