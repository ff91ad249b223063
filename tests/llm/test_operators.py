"""Text operators on a small dirty table, against plain definitions."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from pdwatch.llm import (  # noqa: E402
    decontamination,
    knn,
    language,
    packing,
    pii,
    repeats,
    sharding,
    simhash,
    substrings,
    token_files,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, shard string"


def _rows():
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(60)]
    passage = " ".join(rng.choice(words, 45))
    texts = [" ".join(rng.choice(words, 30)) + f" {n} " + passage[n:] + " " + " ".join(rng.choice(words, 9)) for n in range(6)]
    texts += [texts[0], texts[0], None, "", "  \n\t ", "a" * 1000, "ab" * 400, "é" * 250, texts[1].replace("w1 ", "W1  ")]
    texts += ["mail x.y@z.example.org, +1 (555) 123-4567; 10.0.0.256 10.0.0.1, 4111 1111 1111 1111", "a@b.c_d@e.f.g", "12345"]
    ids = [*range(len(texts) - 2), 3, None]
    rows = [(i, t, "en", None, None, "x", "y") for i, t in zip(ids, texts, strict=True)]
    return [*rows, rows[0], rows[-1]]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _sorted(found):
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("frequent", [1024, 2])
def test_repeats(docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    data = [(row[0], (row[1] or "").encode()) for row in rows]
    counts: dict[bytes, int] = {}
    for _, b in data:
        for s in range(len(b) - 199):
            counts[b[s : s + 200]] = counts.get(b[s : s + 200], 0) + 1
    expected = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if counts[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert _sorted(repeats.remove_repeats(docs).collect()) == _sorted(expected)


def test_substrings(docs, rows):
    data = [(row[0], re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")) for row in rows]
    first: dict[tuple, int] = {}
    for i, w in data:
        for s in range(len(w) - 12):
            if i is not None:
                first[tuple(w[s : s + 13])] = min(first.get(tuple(w[s : s + 13]), i), i)
    expected = []
    for i, w in data:
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if i is not None and first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        kept = " ".join(x for x, no in zip(w, gone, strict=True) if not no)
        expected.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert _sorted(substrings.remove_repeated(docs).collect()) == _sorted(expected)


def test_near_duplicates_and_one_per_group(docs, rows):
    def mark(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[s : s + 3]) for s in range(max(len(w) - 2, 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(row[1]) for row in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (marks[a] ^ marks[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    expected = [(row[0], f"{m:016x}", least[g]) for row, m, g in zip(rows, marks, group, strict=True)]
    found = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert _sorted(found) == _sorted(expected)
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] is None or r["doc_id"] for r in kept.collect()) == sorted(i is None or i for i in least.values())


def test_personal_data(docs, rows):
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    mail = next(row for row in rows if row[1] and row[1].startswith("mail"))
    assert [s.split(":")[0] for s in found[mail[0]].split(",")] == ["email", "phone", "ip", "card"]
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    text = masked.where(f"doc_id = {mail[0]}").first()["text"]
    assert text == "mail <EMAIL>, <PHONE>; 10.0.0.256 <IP>, <CARD>"
    assert masked.where("text is null").count() == 1


def test_decontamination(spark, docs, rows):
    items = spark.createDataFrame([(1, rows[2][1][40:140]), (2, None), (3, "12345"), (None, "a@b")], "item_id int, text string")
    found = decontamination.contamination(docs, items).collect()
    assert len(found) == len(rows)
    by_id = {(r["doc_id"], r["n_words"]): r for r in found}
    assert by_id[2, len(rows[2][1].split())]["contaminated"]
    assert decontamination.drop_contaminated(docs, items).columns == docs.columns
    assert not decontamination.contamination(docs, items.limit(0)).where("contaminated").count()


def test_sharding_is_exact(docs, rows):
    out = sharding.shard_documents(docs, 4).collect()
    sizes = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(4)}
    assert all(slots == list(range(len(slots))) for slots in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert sum(map(len, sizes.values())) == len(rows)
    data = [(row[0], None if row[1] is None else row[1].encode()) for row in rows]
    expected = [(i, 8 if b is None else len(b) + 8, None if b is None else zlib.crc32(b)) for i, b in data]
    assert _sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == _sorted(expected)


def test_language_without_letters_or_model(docs):
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect() if r["doc_id"] is not None}
    assert found[8] == found[9] == found[10] == "und"
    assert found[1] == "en"


def test_top_k_with_bad_vectors(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 0.5]), (None, [0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    out = knn.voronoi_top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(1, 1024 * 1024), (5, 1024 * 1024), (None, 0)]


def test_empty_tables(docs):
    none = docs.limit(0)
    for result in (
        repeats.remove_repeats(none), substrings.remove_repeated(none), simhash.near_duplicates(none),
        sharding.shard_documents(none), language.identify(none), pii.find_personal_data(none),
        packing.pack(none, public_tokenizers.path("byte_bpe_50k.json"), keeps_space=True),
        token_files.token_files(none, public_tokenizers.path("word_bpe_49k.json"), keeps_space=False),
    ):
        assert result.count() == 0


def _ids(rows, name):
    """Per row: its id and the little-endian ids of its text with the end id."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    encoded = [[*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1] for row in rows]
    return [(row[0], np.array(ids, "<u4")) for row, ids in zip(rows, encoded, strict=True)]


def test_packing_holds_each_token_once(docs, rows):
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keeps_space=True, context=64).collect()
    expected = []
    for doc_id, ids in _ids(rows, "byte_bpe_50k.json"):
        start = 0
        for length in packing.binary_lengths(len(ids), 64):
            expected.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
            start += length
    assert _sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == _sorted(expected)
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out))) and {r["offset"] for r in out} == {0}


def test_token_files_round_trip(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = sorted(token_files.token_files(docs, path, keeps_space=False).collect(), key=lambda r: r["start"])
    expected = [(i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in _ids(rows, "word_bpe_49k.json")]
    assert _sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == _sorted(expected)
    assert [r["start"] for r in out] == np.cumsum([0, *[r["n_tokens"] for r in out[:-1]]]).tolist()
    named = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert named == sorted(named) and all(r["doc_id"] is None for r in out[: len(out) - len(named)])


def _base_spans(text):
    """The base patterns as given."""
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def valid(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(part) <= 255 for part in value.split("."))
        if kind == "card":
            doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    found = []
    for rank, (kind, pattern) in enumerate(patterns):
        matches = [m for m in re.finditer(pattern, text) if valid(kind, m.group())]
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in matches]
    return [written for _, _, written in sorted(found)]


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(3)
    parts = ["1", "0", "255", "256", ".", "..", "@", "a", "b-c", "é", "\U0001f600", "+", "+1 (", "555", "-", " ", "4111 1111 1111 1111",
             "x@y.zz", "10.0.0.1", "+49 30 1234567", ")", "\n", "_", "%", "00012", "٣"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(400)] + ["", None, "1." * 3000, "a." * 3000 + "@b.c"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in pii.find_personal_data(table).collect()}
    for doc_id, text in enumerate(texts):
        spans = _base_spans(text or "")
        row = out[doc_id]
        assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), repr(text)
        assert row["n_email"] + row["n_ip"] + row["n_card"] + row["n_phone"] == len(spans)
        assert set(spans) <= set(row["spans"].split(",")) | {""}


def test_contamination_equals_plain_search(spark, docs, rows):
    def words(text):
        lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    passage = rows[2][1]
    texts = [passage[40:140], None, "12345", "A@b", passage.upper()[10:90], "  ", "W1", passage[40:140], "not there at all"]
    items = list(enumerate(texts, 1))
    windows = []
    for item_id, text in items:
        w = words(text)
        windows += [(item_id, w[s : s + 10]) for s in range(max(len(w) - 9, 1))] if w else []
    expected = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item_id, window in windows:
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    out = decontamination.contamination(docs, spark.createDataFrame(items, "item_id int, text string"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert _sorted(out.select(*names).collect()) == _sorted(expected)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_language_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    # A text with a letter has a language, so `und` counts as wrong there.
    lettered = out.join(table.select("doc_id", "text"), "doc_id").where(F.col("text").rlike(r"\p{L}"))
    assert lettered.count() > 0.9 * out.count() > 0
    assert lettered.where("lang_pred <> lang").count() <= 0.05 * lettered.count()


@pytest.mark.parametrize("lang, ids", [(None, range(3)), ("en", [0])])
def test_texts_with_letters_stay_without_a_language_model(spark, lang, ids):
    held_out = next(n for n in range(100) if zlib.crc32(str(n).encode()) % 4 == 2)
    rows = [(held_out + n if lang is None else held_out, text, lang) for n in ids for text in ("some words", "été", "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = [row["text"] for row in language.keep_identified(docs).collect()]
    assert sorted(kept) == sorted(["some words", "été"] * len(ids))
