"""Collocations against plain counting, and transducers against dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pdwatch.llm import collocations, transducer  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint, rank string"


def plain(rows, first):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                count[lang].update(tuple(words[n : n + size]) for n in range(len(words) - size + 1))
    out = []
    for lang, found in count.items():
        chosen = {g: a for g, a in found.items() if len(g) > 1 and a >= 10}
        gone = {part for g, a in chosen.items() if len(g) == 3 for part in (g[:2], g[1:]) if 100 * a >= 50 * found[part]}
        scored = []
        for g, a in chosen.items():
            if g not in gone:
                score, k = min((1000000 * a * a // (found[g[:k]] * found[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), found[g[:k]], found[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _rows():
    rng = random.Random(6)
    words = ["of", "the", "The", "new", "york", "times", "naïve", "Ünder", "a\0b", "\x1f", "x", "y", "z", "日本"]
    rows = []
    for n in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n"]) for _ in range(rng.randrange(60)))
        rows.append((n, text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "new york times " * 30, "en"), (3, None, "en"), (3, None, None), (4, "", "fr"), (5, "...", "xx"), rows[0], rows[0]]
    return [*rows, (200, "very long text of the " * 3000, "de")]


@pytest.mark.parametrize("shard, size, fan, limits, asking", [(1 << 20, 12 << 20, 64, 4096, 256), (50, 2000, 3, 4, 5)])
def test_collocations_equal_plain_counting(spark, monkeypatch, shard, size, fan, limits, asking):
    for name, value in {"SHARD_WORDS": shard, "RANGE_BYTES": size, "FAN": fan, "LIMITS": limits, "ASKING": asking}.items():
        monkeypatch.setattr(collocations, name, value)
    rows = _rows()
    docs = spark.createDataFrame([(i, t, lang, "p", 1, "r") for i, t, lang in rows], SCHEMA).repartition(3)
    for first in (2000, 7):
        found = sorted(map(tuple, collocations.collocations(docs, first).collect()))
        assert found == plain(rows, first)
    assert len(found) > 10


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1, "")], SCHEMA)).collect() == []


def _random(rng, size):
    grams = {}
    for _ in range(size):
        length = rng.randrange(1, 4)
        grams[(rng.choice([b"de", b"en"]), *[bytes([97 + rng.randrange(5)]) * rng.randrange(1, 3) for _ in range(length)])] = rng.randrange(1, 4)
    return grams


def _built(grams):
    groups = sorted({g[0] for g in grams})
    words = sorted({w for g in grams for w in g[1:]})
    rows = [[groups.index(g[0]) + 1, *[words.index(w) + 1 for w in g[1:]], *[0] * (4 - len(g))] for g in grams]
    columns = np.array(rows, np.int64).reshape(len(grams), 4).T
    summed, weights = transducer.combined(list(columns), np.array(list(grams.values()), np.int64))
    return transducer.Transducer.build(groups, words, summed, weights)


def _read(t):
    columns, weights = t.entries()
    return {
        (t.groups[g - 1], *[t.words[w - 1] for w in rest if w]): n
        for g, *rest, n in zip(*[c.tolist() for c in columns], weights.tolist(), strict=True)
    }


def test_transducers_hold_add_and_compose_counts(monkeypatch):
    monkeypatch.setattr(transducer, "BLOCK", 7)
    rng = random.Random(2)
    for size in (0, 1, 5, 60, 400):
        one, other = _random(rng, size), _random(rng, size)
        t, u = _built(one), _built(other)
        assert _read(t) == one
        assert _read(transducer.Transducer.from_bytes(t.to_bytes())) == one
        both = transducer.Transducer.build(*transducer.union([t, u]))
        assert _read(both) == dict(Counter(one) + Counter(other))
        columns, mine, theirs = t.composed(u)
        met = {
            (t.groups[g - 1], *[t.words[w - 1] for w in rest if w]): (m, n)
            for g, *rest, m, n in zip(*[c.tolist() for c in columns], mine.tolist(), theirs.tolist(), strict=True)
        }
        assert met == {g: (one[g], other[g]) for g in one if g in other}


def test_equal_states_are_shared():
    grams = {(b"en", first, second): 2 for first in (b"a", b"b", b"c", b"d") for second in (b"x", b"y", b"z")}
    t = _built(grams)
    assert [len(level[0]) - 1 for level in t.levels] == [1, 1, 1, 0]
    assert len(t.levels[2][1]) == 3


def test_rounds_divide_evenly_and_one_is_enough_for_a_few_gigabytes(monkeypatch):
    # 10 GB of text made a second round, which builds all transducers once more.
    assert collocations._strides(10 * (1 << 30) // collocations.RANGE_BYTES) == [1]
    monkeypatch.setattr(collocations, "FAN", 10)
    for slots in (1, 2, 9, 10, 11, 100, 101, 170, 999, 1001):
        strides = collocations._strides(slots)
        assert strides[-1] == 1 and len(strides) == len(str(max(slots - 1, 1)))
        by = [a // b for a, b in zip(strides, strides[1:], strict=False)]
        assert all(n <= 10 and a == b * n for n, a, b in zip(by, strides, strides[1:], strict=False))
        assert slots <= strides[0] * 10 and (not by or -(-slots // strides[0]) <= by[0])


def test_sums_of_packed_numbers_are_those_of_sorted_columns():
    rng = np.random.default_rng(3)
    for most, heaviest in ((5, 4), (1 << 12, 1000), (1 << 20, 1 << 40), ((1 << 32) - 1, 1)):
        columns = [rng.integers(0, most, 700).astype(np.uint32) for _ in range(4)]
        columns = [np.concatenate([c, c[:300]]) for c in columns]
        for weights in (rng.integers(1, heaviest + 1, 1000), None):
            found, total = transducer.combined(columns, weights)
            expected = Counter()
            for row in zip(*[c.tolist() for c in columns], [1] * 1000 if weights is None else weights.tolist(), strict=True):
                expected[row[:4]] += row[4]
            assert list(zip(*[c.tolist() for c in found], strict=True)) == sorted(expected)
            assert total.tolist() == [expected[key] for key in sorted(expected)]
            assert all(c.dtype == np.uint32 for c in found)


def test_a_transducer_is_numbered_once_for_all_that_ask_it(monkeypatch):
    rng = random.Random(9)
    own, asking = _built(_random(rng, 200)), [_built(_random(rng, 30)) for _ in range(5)]
    expected = [t.composed(_built(_read(own))) for t in asking]

    class Counted(list):
        read = 0

        def __iter__(self):
            Counted.read += 1
            return super().__iter__()

    own.words = Counted(own.words)
    found = [t.composed(own) for t in asking]
    # Each asking transducer had all words of the asked one numbered anew.
    assert Counted.read == 1
    for one, other in zip(found, expected, strict=True):
        assert [c.tolist() for c in one[0]] == [c.tolist() for c in other[0]]
        assert one[1].tolist() == other[1].tolist() and one[2].tolist() == other[2].tolist()
