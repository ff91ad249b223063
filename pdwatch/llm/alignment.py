"""Alignment of two tokenizers, with a fast path along the map of identical tokens.

Offsets at which tokens of both end cut a text into groups. Most groups are one token of A and the token of B with the same
bytes. An array from A's ids to B's ids tells these, and how many documents hold each of them linked is counted in vectors
as long as A's vocabulary: such pairs never become rows of a shuffle. Pairs of other groups are counted as rows.

The counts return to the documents: those of identical tokens and of the most frequent other pairs as arrays of bounded
size, the rest by a join on the pair. So no pair that many documents hold gathers their rows in one task.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow, release_memory, utf8
from pdwatch.llm.tokens import CACHED_LENGTH, PieceEncoder, Remembered, _BYTE_CHARACTER
from pdwatch.session import settle

#: Pairs whose counts are sent to all workers: the most frequent ones that are not identical tokens.
SENT_PAIRS = 1 << 17
#: Text bytes and pairs that a worker handles at once.
_HELD_BYTES, _HELD_PAIRS = 1 << 18, 1 << 20
#: Pieces that each of the two tables of a worker takes before it lets the older ones go, which changes no result.
_REMEMBERED = 1 << 18

_SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_CUT = re.compile(r"(?<=[^ ])(?= )")

_ROWS = (
    "part int, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "same binary, other binary"
)

_loaded: dict[tuple[str, str], Tokenizers] = {}


class SpacedPieces(Remembered):
    """A dictionary from runs of text that begin with a space to packed ids of B, which fills itself.

    No token of B has a space behind another character, so a text is the concatenation of such runs.
    """

    def __init__(self, model) -> None:
        super().__init__(_REMEMBERED)
        self.model, self.space = model, array("I", [model.piece_to_id(_SPACE)]).tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            # The model itself adds the first space.
            ids = array("I", self.model.encode(run[1:], num_threads=1)).tobytes() if len(run) > 1 else self.space
        if len(run) <= CACHED_LENGTH:
            self.keep(run, ids)
        return ids


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and B's id for each id of A, -1 without one."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.encoder = PieceEncoder(path_a, keeps_space=True, most=_REMEMBERED)
        self.encoder.tokenizer.encode_special_tokens = True
        vocabulary = self.encoder.tokenizer.get_vocab()
        special = set(self.encoder.special)
        byte_of = {chr(c): bytes([b]) for b, c in _BYTE_CHARACTER.items()}
        byte_of |= {chr(b): bytes([b]) for b in range(256) if b not in _BYTE_CHARACTER}
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            bytes_a[number] = token.encode() if token in special else b"".join([byte_of[c] for c in token])
        model = SentencePieceProcessor(model_file=path_b)
        pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
        self.divisible = not any(_SPACE in piece.lstrip(_SPACE) for piece in pieces)
        self.model, self.runs = model, SpacedPieces(model)
        bytes_b = []
        for number, piece in enumerate(pieces):
            hexadecimal = _BYTE_PIECE.fullmatch(piece) if model.is_byte(number) else None
            bytes_b.append(bytes([int(hexadecimal[1], 16)]) if hexadecimal else piece.replace(_SPACE, " ").encode())
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.lengths_a = np.array([len(x) for x in bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in bytes_b], np.int64)
        # Of several tokens of B with the same bytes, the written piece is the identical one, not the byte.
        known: dict[bytes, int] = {}
        for number in sorted(range(len(pieces)), key=lambda n: (not model.is_byte(n), -n)):
            known[bytes_b[number]] = number
        self.identity = np.array([known.get(x, -1) if x else -1 for x in bytes_a], np.int64)
        size_a, size_b = len(bytes_a), len(bytes_b)
        self.written = [f"{n},".encode() for n in range(size_a)] + [f"{n}|".encode() for n in range(size_a)]
        self.written += [f"{n},".encode() for n in range(size_b)] + [f"{n};".encode() for n in range(size_b)]

    def encode_b(self, text: str) -> np.ndarray:
        if not self.divisible:
            return np.array(self.model.encode(text, num_threads=1), np.int64)
        spaced = " " + text
        if "  " in spaced or "\0" in spaced or _SPACE in spaced:
            runs = _CUT.split(spaced)
        else:
            runs = spaced.replace(" ", "\0 ").split("\0")[1:]
        if _SPACE in spaced:
            # The model reads this character as a space; then its bytes differ from the text's in any case.
            return np.array(self.model.encode(text, num_threads=1), np.int64)
        return np.frombuffer(b"".join(map(self.runs.__getitem__, runs)), "<u4").astype(np.int64)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for one text; nothing if the tokens' bytes are not those of a space and the text."""
        try:
            written = text.decode()
        except UnicodeDecodeError:
            return None
        if not written:
            return None
        a, b = self.encoder.encode(" " + written).astype(np.int64), self.encode_b(written)
        whole = b" " + text
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            return None
        return (a, b) if b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole else None


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def _products(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, groups: int, size_a: int, size_b: int):
    """Group, ids and number of occurrences of all pairs inside the groups."""
    keys_a, times_a = _summed(group_a * size_a + a, np.ones(len(a), np.int64))
    keys_b, times_b = _summed(group_b * size_b + b, np.ones(len(b), np.int64))
    group_a, a = np.divmod(keys_a, size_a)
    group_b, b = np.divmod(keys_b, size_b)
    width = np.bincount(group_b, minlength=groups)
    start = np.cumsum(width) - width
    repeats = width[group_a]
    left = np.repeat(np.arange(len(a)), repeats)
    within = np.arange(len(left)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    right = start[group_a[left]] + within
    return group_a[left], a[left], b[right], times_a[left] * times_b[right]


def align(both: list[tuple[np.ndarray, np.ndarray]], t: Tokenizers) -> list[tuple]:
    """For each text: counts of tokens, groups and links, the checksum of the groups, and its distinct pairs.

    Pairs come as two arrays of rows: id of A and occurrences for identical tokens; both ids and occurrences else.
    """
    size_a, size_b = len(t.bytes_a), len(t.bytes_b)
    a, b = (np.concatenate([x[side] for x in both]) for side in (0, 1))
    many_a, many_b = (np.array([len(x[side]) for x in both]) for side in (0, 1))
    doc_a, doc_b = np.repeat(np.arange(len(both)), many_a), np.repeat(np.arange(len(both)), many_b)
    ends_a, ends_b = np.cumsum(t.lengths_a[a]), np.cumsum(t.lengths_b[b])
    last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
    last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    doc_of = doc_a[last_a]
    n_groups = np.bincount(doc_of, minlength=len(both))
    n_links = np.bincount(doc_of, weights=(of_a * of_b).astype(float), minlength=len(both)).astype(np.int64)

    one = (of_a == 1) & (of_b == 1)
    single_a, single_b = a[one[group_a]], b[one[group_b]]
    exact = t.identity[single_a] == single_b
    group, pair_a, pair_b, times = _products(
        group_a[~one[group_a]], a[~one[group_a]], group_b[~one[group_b]], b[~one[group_b]], groups, size_a, size_b
    )
    doc = np.concatenate([doc_of[one][~exact], doc_of[group]])
    pair_a, pair_b = np.concatenate([single_a[~exact], pair_a]), np.concatenate([single_b[~exact], pair_b])
    times = np.concatenate([np.ones(int((~exact).sum()), np.int64), times])
    # Identical tokens that are linked inside a longer group count like any other link of theirs.
    identical = t.identity[pair_a] == pair_b
    keys, same_times = _summed(
        np.concatenate([doc_of[one][exact] * size_a + single_a[exact], doc[identical] * size_a + pair_a[identical]]),
        np.concatenate([np.ones(int(exact.sum()), np.int64), times[identical]]),
    )
    same_doc, same_a = np.divmod(keys, size_a)
    rest = ~identical
    keys, other_times = _summed((doc[rest] * size_a + pair_a[rest]) * size_b + pair_b[rest], times[rest])
    other_doc, other = np.divmod(keys, size_a * size_b)

    # Written form: a group's tokens of A before its tokens of B.
    codes = np.concatenate([a + size_a * last_a, 2 * size_a + b + size_b * last_b])
    order = np.lexsort((np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]), np.concatenate([group_a, group_b])))
    written = list(map(t.written.__getitem__, codes[order].tolist()))
    ends = np.cumsum(many_a + many_b).tolist()
    cut_same = np.searchsorted(same_doc, np.arange(len(both) + 1)).tolist()
    cut_other = np.searchsorted(other_doc, np.arange(len(both) + 1)).tolist()
    out, at = [], 0
    for n in range(len(both)):
        digest = hashlib.sha256(b"".join(written[at : ends[n]])[:-1]).hexdigest()
        at = ends[n]
        s, o = slice(*cut_same[n : n + 2]), slice(*cut_other[n : n + 2])
        out.append(
            (int(many_a[n]), int(many_b[n]), int(n_groups[n]), int(n_links[n]), digest,
             np.stack([same_a[s], same_times[s]]), np.stack([other[o], other_times[o]]))
        )
    return out


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row of _ROWS for each document; `part` and `row` name it once the table is written."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizers(path_a, path_b)
        part, number = TaskContext.get().partitionId(), 0
        nothing = np.zeros((2, 0), "<i8").tobytes()

        def made(ids: list, texts: list[bytes]) -> pd.DataFrame:
            nonlocal number
            encoded = [t.encode(text) for text in texts]
            found = [x for x in encoded if x is not None]
            done = iter(align(found, t) if found else [])
            rows = []
            for doc_id, x in zip(ids, encoded, strict=True):
                if x is None:
                    rows.append((part, number, doc_id, 0, 0, 0, 0, "", nothing, nothing))
                else:
                    *numbers, same, other = next(done)
                    rows.append((part, number, doc_id, *numbers, same.astype("<i8").tobytes(), other.astype("<i8").tobytes()))
                number += 1
            columns = [c.split()[0] for c in _ROWS.split(", ")]
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                if held and held + len(text) > _HELD_BYTES:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
            if ids:
                yield made(ids, texts)
        release_memory()

    rows = narrow(docs, doc_id="doc_id", text="text").select("doc_id", utf8(F.col("text")).alias("text"))
    return rows.mapInPandas(compute, _ROWS)


def _both(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(2, -1)


def identity_counts(rows: DataFrame, size_a: int) -> np.ndarray:
    """How many documents hold each token of A linked to its identical token: one vector a task, added up by id."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vector = np.zeros(size_a, np.int64)
        for batch in batches:
            for data in batch["same"]:
                vector[_both(data)[0]] += 1
        found = np.flatnonzero(vector)
        yield pd.DataFrame({"a": found, "n": vector[found]})

    # As many rows as A has tokens.
    summed = rows.select("same").mapInPandas(count, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n")).toPandas()
    vector = np.zeros(size_a, np.int64)
    vector[summed["a"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return vector


def pair_counts(rows: DataFrame) -> DataFrame:
    """`pair` (both ids in one number) and `n`, the documents that hold it, for pairs that are not identical tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for data in batch["other"]:
                held.append(_both(data)[0])
                size += len(held[-1])
                if size > _HELD_PAIRS:
                    found, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"pair": found, "n": n})
                    held, size = [], 0
        if held:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"pair": found, "n": n})

    return rows.select("other").mapInPandas(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links of each document, and how common its links are in the corpus. One row for each row of `docs`.

    A is a byte-level tokenizer file, B a piece model that adds a space. Defined results: a text that is null or empty, or
    whose tokens of A or of B do not give back a space and the text, has no tokens: zeros and an empty checksum, and counts
    nowhere. Rows that repeat an id or have none are documents of their own.
    """
    t = tokenizers(path_a, path_b)
    size_a, size_b = len(t.bytes_a), len(t.bytes_b)
    rows = settle(aligned(docs, path_a, path_b), "aligned")
    vector = identity_counts(rows, size_a)
    pairs = settle(pair_counts(rows), "pair-counts")
    of_a = F.expr(f"pair div {size_b}")
    # As many rows as A has tokens, at most.
    most = pairs.groupBy(of_a.alias("a")).agg(F.max("n").alias("n")).toPandas()
    best = vector.copy()
    at = most["a"].to_numpy(np.int64)
    best[at] = np.maximum(best[at], most["n"].to_numpy(np.int64))
    sent = pairs.orderBy(F.desc("n"), "pair").limit(SENT_PAIRS).toPandas().sort_values("pair")
    sent_pairs, sent_counts = sent["pair"].to_numpy(np.int64), sent["n"].to_numpy(np.int64)
    known = docs.sparkSession.sparkContext.broadcast((vector, best, sent_pairs, sent_counts))

    def place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the pair was sent, and its place."""
        sent = known.value[2]
        if not len(sent):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(sent, keys), len(sent) - 1)
        return sent[at] == keys, at

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vector, best, _, counts = known.value
        for batch in batches:
            bests, sums = [], []
            for same, other in zip(batch["same"], batch["other"], strict=True):
                (a, times), (pair, pair_times) = _both(same), _both(other)
                here, at = place(pair)
                n, pair_times = counts[at[here]] if len(counts) else at[here], pair_times[here]
                bests.append(int(times[vector[a] == best[a]].sum() + pair_times[n == best[pair[here] // size_b]].sum()))
                sums.append(int((times * vector[a]).sum() + (pair_times * n).sum()))
            yield batch.drop(columns=["same", "other"]).assign(near_best=bests, near_sum=sums)

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, row, data in zip(batch["part"], batch["row"], batch["other"], strict=True):
                pair, times = _both(data)
                away = ~place(pair)[0]
                if away.any():
                    yield pd.DataFrame({"part": part, "row": row, "pair": pair[away], "times": times[away]})

    columns = "part int, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    seen = rows.withColumn("doc_id", F.col("doc_id")).mapInPandas(near, columns + ", near_best bigint, near_sum bigint")
    highest = docs.sparkSession.createDataFrame(
        pd.DataFrame({"a": np.flatnonzero(best), "best": best[best > 0]}), "a bigint, best bigint"
    )
    asked = rows.select("part", "row", "other").mapInPandas(far, "part int, row bigint, pair bigint, times bigint")
    rest = (
        asked.join(pairs.hint("merge"), "pair")
        .join(F.broadcast(highest), of_a == F.col("a"))  # as many rows as A has tokens
        .groupBy("part", "row")
        .agg(
            F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("far_best"),
            F.sum(F.col("times") * F.col("n")).alias("far_sum"),
        )
    )
    none = F.lit(0)
    return seen.join(rest, ["part", "row"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("near_best") + F.coalesce("far_best", none)).alias("n_best"),
        (F.col("near_sum") + F.coalesce("far_sum", none)).alias("count_sum"),
        "groups_sha256",
    )
