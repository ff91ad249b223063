"""Phrase collocations from count transducers: weighted acyclic automata of the n-grams of shards of the corpus.

Each shard (a bounded run of words in a task) sorts its n-grams of one to three words and builds a transducer from them,
one for each range of n-grams. Ranges are prefix ranges of the order (language, words); where more are wanted than limits
are kept, a range is divided further by a hash of the n-gram. Transducers of one range are united and their weights
added up. That takes as many rounds as keep the parts of a shard from becoming smaller with the corpus: a round
divides by FAN and unites shards in batches, the last one unites all shards of a range. Only then are n-grams that are too
rare to be a candidate or a part of one left out.

Counts of the parts of candidates are found by composition: the parts a range asks for are a transducer too, whose
weights are the counts of the longest candidate around the part. It is sent to the ranges that hold the parts,
walked together with theirs, and sent back with the counts. The asking weights tell which candidates are covered.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow, release_memory, utf8
from pdwatch.llm.transducer import Transducer, boundary, combined, restricted, sorted_keys, union
from pdwatch.session import settle

LONGEST = 3
LEAST = 10
#: A phrase goes if a longer one around it has at least so many hundredths of its count.
COVERED = 50
FIRST = 2000
SCALE = 1_000_000
UNKNOWN = "und"

#: Words of a shard; text bytes whose n-grams make a range; parts that a round divides into; limits that are kept.
SHARD_WORDS, RANGE_BYTES, FAN, LIMITS = 3 << 18, 4 << 20, 1 << 12, 1 << 12
#: Transducers that are handed to Spark together.
SENT = 64
#: Documents and n-grams of each from which the limits are taken. They decide which range holds an n-gram, no result.
SAMPLED, DRAWN = 1 << 10, 64
#: Asking ranges whose questions one task answers.
ASKING = 256

_MARK = b"\xff"
_ROWS = "slot bigint, batch bigint, data binary"
_PIECES = bytes.maketrans(bytes([*b".,;:!?", *range(0x0A, 0x0E), 0x09]), _MARK * 10 + b" ")


def _words(text: bytes) -> list[bytes]:
    """Words in order, with a mark at each end of a piece and at the end."""
    return [*text.lower().translate(_PIECES).replace(_MARK, b" \xff ").split(), _MARK]


def counted(languages: np.ndarray, words: list[bytes], starts: int) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """The sorted words, and all n-grams that begin at the first `starts` words, with their counts."""
    table = sorted(set(words) - {_MARK})
    rank = {word: n for n, word in enumerate(table, 1)}
    rank[_MARK] = 0
    ranks = np.zeros(len(words) + LONGEST, np.uint32)
    ranks[: len(words)] = np.fromiter(map(rank.__getitem__, words), np.uint32, len(words))
    columns: list[list[np.ndarray]] = [[] for _ in range(LONGEST + 1)]
    here = np.flatnonzero(ranks[:starts])
    for length in range(1, LONGEST + 1):
        here = here[ranks[here + length - 1] > 0]
        columns[0].append(languages[here])
        for n in range(LONGEST):
            columns[n + 1].append(ranks[here + n] if n < length else np.zeros(len(here), np.uint32))
    grams = [np.concatenate(c) for c in columns]
    return table, *combined(grams)


def _slots(groups: list[bytes], words: list[bytes], columns: list[np.ndarray], limits: list, classes: int) -> np.ndarray:
    """The slot of each of the sorted n-grams: its prefix range and, inside it, the class of its hash."""
    cuts = np.array([boundary(groups, words, columns, limit) for limit in limits], np.int64)
    place = np.searchsorted(cuts, np.arange(len(columns[0])), side="right")
    if classes == 1:
        return place
    of_group = np.array([0, *[xxhash.xxh64_intdigest(s) for s in groups]], np.uint64)
    of_word = np.array([0, *[xxhash.xxh64_intdigest(s) for s in words]], np.uint64)
    mixed = of_group[columns[0]]
    for column in columns[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + of_word[column]
    return place * classes + ((mixed >> np.uint64(32)) % np.uint64(classes)).astype(np.int64)


def _divided(groups, words, columns, weights, limits, classes: int, stride: int) -> Iterator[tuple[int, Transducer]]:
    """Transducers of the n-grams of each run of `stride` slots."""
    if not len(weights):
        return
    part = _slots(groups, words, columns, limits, classes) // stride
    order = None
    if classes > 1:
        order = np.argsort(part, kind="stable")
        part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # Prefix ranges are runs of the sorted n-grams.
        rows = slice(start, end) if order is None else order[start:end]
        yield int(part[start]), restricted(groups, words, [c[rows] for c in columns], weights[rows])


def _texts(docs: DataFrame) -> DataFrame:
    return narrow(docs, lang="lang", text="text").select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), utf8(F.col("text")).alias("text")
    )


def _limits(texts: DataFrame, documents: int, wanted: int) -> list[tuple[bytes, ...]]:
    """Prefix limits that cut a sample of n-grams into equal parts."""
    if wanted < 2:
        return []

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, text in zip(batch["lang"], batch["text"], strict=True):
                words = _words(text)
                at = np.random.default_rng(len(words)).integers(0, len(words), DRAWN).tolist()
                grams = [words[n : n + 1 + k % LONGEST] for k, n in enumerate(at)]
                yield pd.DataFrame([(language.encode(), b" ".join(g)) for g in grams if _MARK not in g], columns=["lang", "gram"])

    share = SAMPLED / max(documents, SAMPLED)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    # At most DRAWN for each of about SAMPLED documents; equal texts are one draw.
    drawn = sample.distinct().mapInPandas(draw, "lang binary, gram binary").limit(4 * SAMPLED * DRAWN).collect()
    ordered = sorted((bytes(lang), *bytes(gram).split(b" ")) for lang, gram in drawn)
    return sorted({ordered[len(ordered) * n // wanted] for n in range(1, wanted)}) if ordered else []


def _shards(texts: DataFrame, limits: list, classes: int, stride: int, batches_of: int) -> DataFrame:
    """Rows of _ROWS: transducers of the n-grams of each shard, by run of slots and batch."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[bytes] = []
        languages: list[tuple[bytes, int]] = []
        shard = 0

        def made(starts: int) -> Iterator[pd.DataFrame]:
            nonlocal shard
            groups = sorted({language for language, _ in languages})
            number = {language: n for n, language in enumerate(groups, 1)}
            of = np.repeat(
                np.array([number[x] for x, _ in languages], np.uint32), np.array([n for _, n in languages], np.int64)
            )
            table, columns, weights = counted(of, words[: starts + LONGEST], starts)
            batch = xxhash.xxh64_intdigest(str((len(table), int(weights.sum()), shard)).encode()) % batches_of
            shard += 1
            rows = []
            for slot, part in _divided(groups, table, columns, weights, limits, classes, stride):
                rows.append((slot, batch, part.to_bytes()))
                if len(rows) == SENT:
                    yield pd.DataFrame(rows, columns=["slot", "batch", "data"])
                    rows = []
            yield pd.DataFrame(rows, columns=["slot", "batch", "data"])

        for frame in batches:
            for language, text in zip(frame["lang"], frame["text"], strict=True):
                found = _words(text)
                words += found
                languages.append((language.encode(), len(found)))
                while len(words) >= SHARD_WORDS + LONGEST:
                    yield from made(SHARD_WORDS)
                    # N-grams that begin at the next word are those of the next shard.
                    left = len(words) - SHARD_WORDS
                    words = words[SHARD_WORDS:]
                    kept: list[tuple[bytes, int]] = []
                    for name, many in reversed(languages):
                        kept.append((name, min(many, left)))
                        left -= kept[-1][1]
                        if not left:
                            break
                    languages = kept[::-1]
        if words:
            yield from made(len(words))
        release_memory()

    return texts.mapInPandas(compute, _ROWS)


def _dividing(limits: list, classes: int, stride: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Unites the transducers of some shards for one run of slots and divides them for the shorter runs of `stride`."""

    def divide(group: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        parts = _divided(*union([Transducer.from_bytes(x) for x in group["data"]]), limits, classes, stride)
        batch = int(group["batch"].iloc[0]) % stride
        return pd.DataFrame([(slot, batch, part.to_bytes()) for slot, part in parts], columns=["slot", "batch", "data"])

    return divide


def _strides(slots: int) -> list[int]:
    """The lengths of the runs of slots that each round divides for. All rounds divide into about as many, FAN at most."""
    rounds = next(n for n in itertools.count(1) if FAN**n >= slots)
    by = next(n for n in itertools.count(1) if n**rounds >= slots)
    return [by**n for n in range(rounds - 1, -1, -1)]


def count_transducers(docs: DataFrame) -> tuple[DataFrame, DataFrame, list, int, int]:
    """The written transducers by slot, words of each language, and what tells the slot of an n-gram.

    Transducers hold all n-grams that occur at least LEAST times in their language.
    """
    texts = _texts(docs)
    documents, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = max(8, -(-size // RANGE_BYTES))
    limits = _limits(texts, documents, min(wanted, LIMITS))
    classes = -(-wanted // (len(limits) + 1)) if wanted > LIMITS else 1
    slots = (len(limits) + 1) * classes
    first, *rest = _strides(slots)
    rows = _shards(texts, limits, classes, first, first)
    for stride in rest:
        rows = rows.groupBy("slot", "batch").applyInPandas(_dividing(limits, classes, stride), _ROWS)

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        groups, words, columns, weights = union([Transducer.from_bytes(x) for x in group["data"]])
        single = columns[2] == 0
        total = np.bincount(columns[0][single], weights=weights[single].astype(float), minlength=len(groups) + 1)[1:]
        often = weights >= LEAST
        slot = int(group["slot"].iloc[0])
        made = [(slot, g.decode(), int(n), None) for g, n in zip(groups, total.tolist(), strict=True) if n]
        if often.any():
            part = restricted(groups, words, [c[often] for c in columns], weights[often])
            made.append((slot, None, None, part.to_bytes()))
        return pd.DataFrame(made, columns=["slot", "lang", "n", "data"]).astype({"n": "Int64"})

    written = settle(rows.groupBy("slot").applyInPandas(unite, "slot bigint, lang string, n bigint, data binary"), "counts")
    counts = written.where(F.col("data").isNotNull()).select("slot", "data")
    totals = written.where(F.col("data").isNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    return counts, totals, limits, classes, slots


def _parts(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The parts of all candidates, each with the largest count of a candidate of three words around it, or 1."""
    group, one, two, three = columns
    none = np.zeros(len(group), np.uint32)
    pair, triple = (two > 0) & (three == 0), three > 0
    asked = [
        (pair, one, none, False), (pair, two, none, False), (triple, one, none, False), (triple, three, none, False),
        (triple, one, two, True), (triple, two, three, True),
    ]
    grams = [
        np.concatenate([group[m] for m, *_ in asked]),
        np.concatenate([first[m] for m, first, _, _ in asked]),
        np.concatenate([second[m] for m, _, second, _ in asked]),
    ]
    around = np.concatenate([weights[m] if inside else np.ones(int(m.sum()), np.int64) for m, _, _, inside in asked])
    return _largest([*grams, np.zeros(len(around), np.uint32)], around)


def _largest(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order, first = sorted_keys(columns)
    if not len(order):
        return columns, weights
    return [c[order[first]] for c in columns], np.maximum.reduceat(weights[order], first)


def _table(t: Transducer) -> dict[tuple[bytes, ...], int]:
    columns, weights = t.entries()
    groups, words = [b"", *t.groups], [b"", *t.words]
    return {
        (groups[g], words[a], words[b]): n
        for g, a, b, n in zip(*[c.tolist() for c in columns[:3]], weights.tolist(), strict=True)
    }


def _score(a: int, left: int, right: int) -> int:
    return SCALE * a * a // (left * right)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`lang`, `phrase`, `a`, `l`, `r`, `score` of all candidates that no longer one covers, and the words of each language."""
    counts, totals, limits, classes, slots = count_transducers(docs)
    salts = 1 + slots // ASKING

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slot, data in zip(batch["slot"].tolist(), batch["data"], strict=True):
                t = Transducer.from_bytes(data)
                columns, around = _parts(*t.entries())
                parts = _divided(t.groups, t.words, columns, around, limits, classes, 1)
                rows = [(target, slot % salts, slot, part.to_bytes()) for target, part in parts]
                yield pd.DataFrame(rows, columns=["slot", "salt", "source", "data"])

    kept = "slot bigint, salt bigint, source bigint, data binary"
    asked = counts.mapInPandas(ask, kept)
    held = counts.select(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"),
        F.lit(-1).cast("bigint").alias("source"), "data",
    )

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        """To each asking slot the counts of its parts; to this slot (source -2) its phrases that are covered."""
        release_memory()
        slot = int(group["slot"].iloc[0])
        own = Transducer.from_bytes(group.loc[group["source"] == -1, "data"].iloc[0])
        rows, covered, about = [], [], []
        for source, data in zip(group["source"].tolist(), group["data"], strict=True):
            if source < 0:
                continue
            asking = Transducer.from_bytes(data)
            columns, around, count = asking.composed(own)
            order = np.lexsort(columns[::-1])
            columns, around, count = [c[order] for c in columns], around[order], count[order]
            rows.append((source, 0, slot, restricted(asking.groups, asking.words, columns, count).to_bytes()))
            gone = (100 * around >= COVERED * count) & (columns[2] > 0)
            if gone.any():
                covered.append(restricted(asking.groups, asking.words, [c[gone] for c in columns], around[gone]))
        if covered:
            groups, words, columns, weights = union(covered)
            rows.append((slot, 0, -2, restricted(groups, words, columns, weights).to_bytes()))
        return pd.DataFrame(rows, columns=["slot", "salt", "source", "data"])

    answers = asked.unionByName(held).groupBy("slot", "salt").applyInPandas(answer, kept)

    def score(group: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        own, count, covered = None, {}, set()
        for source, data in zip(group["source"].tolist(), group["data"], strict=True):
            t = Transducer.from_bytes(data)
            if source == -1:
                own = t
            elif source == -2:
                covered.update(_table(t))
            else:
                count.update(_table(t))
        columns, weights = own.entries()
        groups, words = [b"", *own.groups], [b"", *own.words]
        rows = []
        for g, one, two, three, a in zip(*[c.tolist() for c in columns], weights.tolist(), strict=True):
            lang, x, y, z = groups[g], words[one], words[two], words[three]
            if not two or (not three and (lang, x, y) in covered):
                continue
            if three:
                cuts = [(count[lang, x, b""], count[lang, y, z]), (count[lang, x, y], count[lang, z, b""])]
            else:
                cuts = [(count[lang, x, b""], count[lang, y, b""])]
            # The first of equal scores is the smallest cut.
            left, right = min(cuts, key=lambda cut: _score(a, *cut))
            phrase = b" ".join([x, y, z] if three else [x, y])
            rows.append((lang.decode(), phrase.decode(), a, left, right, _score(a, left, right)))
        return pd.DataFrame(rows, columns=["lang", "phrase", "a", "l", "r", "score"])

    own = counts.select("slot", F.lit(0).cast("bigint").alias("salt"), F.lit(-1).cast("bigint").alias("source"), "data")
    schema = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"
    return answers.unionByName(own).groupBy("slot").applyInPandas(score, schema), totals


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """The first phrases of each language by score, count and phrase.

    Defined results: a null text has no words, a null language is `und`; words are counted for each row, also where rows
    repeat an id or have none; a language without candidates gives no rows. Counts and scores are exact integers.
    """
    found, totals = candidates(docs)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
