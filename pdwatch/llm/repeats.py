"""Removal of byte strings that occur twice, by suffix sorting of the places where they may differ.

Every string of LENGTH bytes contains an anchor: the k-gram with the smallest hash among its k-grams. Equal strings
have the same anchor at the same place, so only the surroundings of equal anchors are compared. A sketch drops anchors
that occur once. The others are sent with their surroundings, once per chunk and distinct surroundings, to the shard of
the anchor. There a surrounding that occurs twice is repeated as a whole. Different surroundings of one anchor are cut
into columns, columns in which all agree become one symbol, and the suffix array of all symbols gives the longest match
of each suffix. Anchors that are very frequent are asked window by window instead, so no anchor makes a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.llm import sketch
from pdwatch.llm.exchange import Chunk, arrays, chunks, packed, spans_of_documents, texts_of, unpacked, with_spans
from pdwatch.llm.substrings import spans_by_document, window_hash
from pdwatch.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 200
GRAM = 96
#: Estimated occurrences from which an anchor is asked window by window.
FREQUENT = 1024
#: Text bytes per shard that the number of shards is chosen for.
SHARD_BYTES = 1 << 20
#: Text bytes of a chunk. Its anchors' surroundings may take six times as many.
CHUNK_BYTES = 4 << 20
#: Symbols that are sorted in one run.
RUN_SYMBOLS = 1 << 14

_SIDE = LENGTH - GRAM
_WIDTH = LENGTH + _SIDE
_BLOCK = 1 << 18
_SLICE = 1 << 11
_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_CONTEXT = np.dtype(
    [("key", "<u8"), ("digest", "<u8"), ("twice", "?"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (_WIDTH,))]
)
_WINDOW = np.dtype([("key", "<u8"), ("check", "<u4"), ("twice", "?")])


def _mixed(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _sliding(values: np.ndarray, size: int, take) -> np.ndarray:
    """The extreme of every `size` consecutive values, from windows of doubled size."""
    held, length = values, 1
    while 2 * length <= size:
        held = take(held[:-length], held[length:])
        length *= 2
    rest = size - length
    return take(held[:-rest], held[rest:]) if rest else held


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a byte array: each k-gram that is smallest in some string."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _mixed(window_hash(data.astype(np.uint64) + np.uint64(1), GRAM, _FIRST))
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    per_string = LENGTH - GRAM + 1
    least = _sliding(high, per_string, np.minimum)
    edge = np.zeros(per_string - 1, np.uint32)
    best = _sliding(np.concatenate([edge, least, edge]), per_string, np.maximum)
    found = np.flatnonzero(best == high)
    return found, hashes[found]


class _Bytes:
    """The joined texts of a chunk and its anchors that lie inside one document."""

    def __init__(self, chunk: Chunk) -> None:
        self.lengths = np.array([len(text) for text in chunk.texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = np.frombuffer(b"".join(chunk.texts), np.uint8)
        places, keys = [], []
        for start in range(0, len(self.data), _BLOCK):
            # Blocks overlap, so that each string lies in one of them.
            at, key = anchors_of(self.data[start : start + _BLOCK + LENGTH - 1])
            places.append(at + start)
            keys.append(key)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        at, first = np.unique(at, return_index=True)
        doc = np.searchsorted(self.ends, at, side="right")
        inside = at + GRAM <= self.ends[doc] if len(at) else np.zeros(0, bool)
        self.at, self.key, self.doc = at[inside], key[first][inside], doc[inside]

    def surroundings(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes around anchors (zero outside the document), and how many there are to the left and right."""
        begin = self.ends[doc] - self.lengths[doc]
        left = np.minimum(at - begin, _SIDE)
        right = np.minimum(self.ends[doc] - at - GRAM, _SIDE)
        column = np.arange(_WIDTH)
        index = at[:, None] - _SIDE + column
        out = self.data[np.clip(index, 0, max(len(self.data) - 1, 0))]
        outside = (column < (_SIDE - left)[:, None]) | (column >= (_SIDE + GRAM + right)[:, None])
        out[outside] = 0
        return out, left.astype(np.uint8), right.astype(np.uint8)

    def strings_around(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and two hashes of all strings that contain one of the anchors."""
        begin = self.ends[doc] - self.lengths[doc]
        first = np.maximum(at - _SIDE, begin)
        last = np.minimum(at, self.ends[doc] - LENGTH)
        wanted = last >= first
        first, last = first[wanted], last[wanted]
        starts, keys, checks = [], [], []
        for block in range(0, len(self.data), _BLOCK):
            low, high = np.maximum(first, block), np.minimum(last + 1, block + _BLOCK)
            some = high > low
            if not some.any():
                continue
            delta = np.zeros(_BLOCK + 1, np.int32)
            np.add.at(delta, low[some] - block, 1)
            np.add.at(delta, high[some] - block, -1)
            here = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
            values = self.data[block : block + _BLOCK + LENGTH - 1].astype(np.uint64) + np.uint64(1)
            starts.append(here + block)
            keys.append(_mixed(window_hash(values, LENGTH, _FIRST)[here]))
            checks.append((_mixed(window_hash(values, LENGTH, _SECOND)[here]) >> np.uint64(32)).astype("<u4"))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, "<u4")
        return np.concatenate(starts), np.concatenate(keys), np.concatenate(checks)


def _count(bits: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, CHUNK_BYTES):
            keys, counts = np.unique(_Bytes(chunk).key, return_counts=True)
            if len(keys):
                yield from sketch.partial(keys, counts, bits)

    return count


def _groups(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of pairs, and the starts of equal ones in it."""
    order = np.lexsort((check, key))
    a, b = key[order], check[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return order, np.flatnonzero(fresh)


def _by_shard(table: np.ndarray, shards: int, first: int) -> tuple[dict[int, bytes], np.ndarray]:
    """Entries in order of their keys, cut by shard; the sizes of the shards."""
    shard = (table["key"] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    bounds = enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return {first + n: table[low:high].tobytes() for n, (low, high) in bounds if high > low}, np.diff(cuts)


def repeated_strings(texts: DataFrame) -> DataFrame:
    """Spans of bytes covered by strings of LENGTH bytes that start elsewhere too."""
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = sketch.bits_for(total // (_SIDE // 3))
    shards = max(64, total // SHARD_BYTES)
    maps = sketch.merged(texts.mapInPandas(_count(bits), sketch.SCHEMA), bits, [2, FREQUENT])
    shared = texts.sparkSession.sparkContext.broadcast(maps)

    def prepare(chunk: Chunk) -> tuple[dict[int, bytes], bytes]:
        held = _Bytes(chunk)
        twice = sketch.at_least(held.key, shared.value[0], bits)
        often = sketch.at_least(held.key, shared.value[1], bits)
        asked, whole = np.flatnonzero(twice & ~often), np.flatnonzero(often)

        at, doc, key = held.at[asked], held.doc[asked], held.key[asked]
        digest = np.zeros(len(at), np.uint64)
        for start in range(0, len(at), _SLICE):
            around, left, right = held.surroundings(at[start : start + _SLICE], doc[start : start + _SLICE])
            rows = np.column_stack([around, left, right])
            digest[start : start + len(rows)] = [xxhash.xxh3_64_intdigest(row) for row in rows]
        order, starts = _groups(key, digest)
        counts = np.diff(np.append(starts, len(order)))
        table = np.zeros(len(starts), _CONTEXT)
        first = order[starts]
        table["key"], table["digest"], table["twice"] = key[first], digest[first], counts > 1
        for start in range(0, len(first), _SLICE):
            some = first[start : start + _SLICE]
            part = table[start : start + len(some)]
            part["bytes"], part["left"], part["right"] = held.surroundings(at[some], doc[some])
        questions, sizes = _by_shard(table, shards, 0)

        begin, window, check = held.strings_around(held.at[whole], held.doc[whole])
        if len(begin):
            inside = np.searchsorted(held.ends, begin, side="right")
            fits = begin + LENGTH <= held.ends[inside]
            begin, window, check = begin[fits], window[fits], check[fits]
        w_order, w_starts = _groups(window, check)
        w_counts = np.diff(np.append(w_starts, len(w_order)))
        w_table = np.zeros(len(w_starts), _WINDOW)
        w_first = w_order[w_starts]
        w_table["key"], w_table["check"], w_table["twice"] = window[w_first], check[w_first], w_counts > 1
        w_questions, w_sizes = _by_shard(w_table, shards, shards)
        notes = packed(
            held.lengths, sizes.astype("<i8"), counts.astype("<i8"), at[order].astype("<u4"),
            w_sizes.astype("<i8"), w_counts.astype("<i8"), begin[w_order].astype("<u4"),
        )
        return questions | w_questions, notes

    def resolve(shard: int, questions: list[bytes]) -> list[bytes]:
        return _answer_windows(questions) if shard >= shards else _answer_contexts(questions)

    def finish(notes: bytes, answers: dict[int, bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lengths, sizes, counts, at, w_sizes, w_counts, w_at = arrays(notes, "<i8", "<i8", "<i8", "<u4", "<i8", "<i8", "<u4")
        if set(answers) != {*np.flatnonzero(sizes).tolist(), *(shards + np.flatnonzero(w_sizes)).tolist()}:
            raise ValueError("a chunk was prepared differently in its two passes")
        numbers, lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for shard in np.flatnonzero(sizes).tolist():
            entry, low, high = arrays(answers[shard], "<u4", "<u2", "<u2")
            numbers.append(entry + offsets[shard])
            lows.append(low.astype(np.int64))
            highs.append(high.astype(np.int64))
        entry, low, high = map(np.concatenate, (numbers, lows, highs))
        # Each span of an entry holds for all its places in the chunk.
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        times = counts[entry]
        index = np.repeat(first[entry], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        base = at[index].astype(np.int64) - _SIDE
        starts, ends = base + np.repeat(low, times), base + np.repeat(high, times)
        bits_found = [
            np.unpackbits(np.frombuffer(answers[shards + n], np.uint8), count=int(w_sizes[n]))
            for n in np.flatnonzero(w_sizes).tolist()
        ]
        if bits_found:
            windows = w_at[np.repeat(np.concatenate(bits_found).astype(bool), w_counts)].astype(np.int64)
            starts, ends = np.concatenate([starts, windows]), np.concatenate([ends, windows + LENGTH])
        yield from spans_by_document(starts, ends, lengths)

    return spans_of_documents(texts, CHUNK_BYTES, prepare, resolve, finish)


def _answer_windows(questions: list[bytes]) -> list[bytes]:
    tables = [np.frombuffer(data, _WINDOW) for data in questions]
    every = np.concatenate(tables)
    order, starts = _groups(every["key"], every["check"])
    counts = np.diff(np.append(starts, len(order)))
    twice = np.logical_or.reduceat(every["twice"][order], starts) | (counts > 1)
    found = np.zeros(len(every), bool)
    found[order] = np.repeat(twice, counts)
    ends = np.cumsum([len(table) for table in tables])
    return [np.packbits(found[end - len(table) : end]).tobytes() for table, end in zip(tables, ends, strict=True)]


def _answer_contexts(questions: list[bytes]) -> list[bytes]:
    """For each question the entries with repeated bytes and where in their surroundings these are."""
    tables = [np.frombuffer(data, _CONTEXT) for data in questions]
    every = np.concatenate(tables)
    order, starts = _groups(every["key"], every["digest"])
    counts = np.diff(np.append(starts, len(order)))
    distinct = every[order[starts]]
    twice = np.logical_or.reduceat(every["twice"][order], starts) | (counts > 1)
    left, right = distinct["left"].astype(np.int64), distinct["right"].astype(np.int64)
    whole = np.flatnonzero(twice & (left + right + GRAM >= LENGTH))
    names, lows, highs = [whole], [_SIDE - left[whole]], [_SIDE + GRAM + right[whole]]

    # Anchors with several surroundings, some of which occur once.
    keys = distinct["key"]
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    tails = np.append(fresh[1:], len(keys))
    several = np.flatnonzero((tails - fresh > 1) & (np.add.reduceat(~twice, fresh) > 0))
    sorter = _Sorter()
    for group in several.tolist():
        sorter.add(np.arange(fresh[group], tails[group]), distinct[fresh[group] : tails[group]])
    for name, low, high in sorter.found():
        names.append(name)
        lows.append(low)
        highs.append(high)
    name, low, high = map(np.concatenate, (names, lows, highs))

    # Spans of a distinct surrounding go to every question that holds it.
    by_name = np.argsort(name, kind="stable")
    name, low, high = name[by_name], low[by_name], high[by_name]
    owner = np.empty(len(every), np.int64)
    owner[order] = np.repeat(np.arange(len(starts)), counts)
    out, begin = [], 0
    for table in tables:
        own = owner[begin : begin + len(table)]
        begin += len(table)
        first, last = np.searchsorted(name, own), np.searchsorted(name, own, side="right")
        times = last - first
        index = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(np.arange(len(own)), times)
        out.append(packed(entry.astype("<u4"), low[index].astype("<u2"), high[index].astype("<u2")))
    return out


class _Sorter:
    """Collects the symbols of many anchors' surroundings and sorts their suffixes in runs of bounded size."""

    def __init__(self) -> None:
        self.results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._clear()

    def _clear(self) -> None:
        self.symbols: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.columns: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.used, self.size = 0, 0

    def add(self, names: np.ndarray, contexts: np.ndarray) -> None:
        data = contexts["bytes"]
        reach_right = _shared(data[:, _SIDE + GRAM :], contexts["right"].astype(np.int64))
        reach_left = _shared(data[:, _SIDE - 1 :: -1] if _SIDE else data[:, :0], contexts["left"].astype(np.int64))
        kept = np.flatnonzero(reach_left + GRAM + reach_right >= LENGTH)
        if len(kept) < 2:
            return
        begin, end = _SIDE - reach_left[kept], _SIDE + GRAM + reach_right[kept]
        data, names = data[kept], names[kept]
        column = np.arange(_WIDTH)
        held = (column >= begin[:, None]) & (column < end[:, None])
        low = np.where(held, data, 255).min(0)
        high = np.where(held, data, 0).max(0)
        agree = low >= high  # of those that reach this column
        cut = np.zeros(_WIDTH + 1, bool)
        cut[begin] = cut[end] = True
        cut[:-1] |= ~agree
        cut[1:] |= ~agree
        cut[0] = cut[-1] = True
        edges = np.flatnonzero(cut)
        segments, widths = edges[:-1], np.diff(edges)
        # A symbol is the segment and, where the surroundings differ, the byte.
        values = segments * 256 + np.where(agree[segments], 0, data[:, segments]) + self.used
        present = held[:, segments]
        for row in range(len(kept)):
            own = present[row]
            self.symbols.append(values[row][own])
            self.widths.append(widths[own])
            self.columns.append(segments[own])
            self.names.append(np.full(int(own.sum()), names[row]))
            self.symbols.append(np.array([-1]))
            self.widths.append(np.array([0]))
            self.columns.append(np.array([0]))
            self.names.append(np.array([-1]))
            self.size += int(own.sum()) + 1
        self.used += _WIDTH * 256
        if self.size >= RUN_SYMBOLS:
            self._run()

    def _run(self) -> None:
        if not self.symbols:
            return
        symbols, widths, columns, names = map(np.concatenate, (self.symbols, self.widths, self.columns, self.names))
        self._clear()
        separators = np.flatnonzero(symbols < 0)
        symbols[separators] = -1 - np.arange(len(separators))  # all different
        order = suffix_array(symbols)
        shared = common_prefixes(symbols, order)
        best = np.zeros(len(symbols), np.int64)
        best[order] = np.maximum(shared, np.append(shared[1:], 0))
        total = np.concatenate([[0], np.cumsum(widths)])
        place = np.arange(len(symbols))
        matched = total[place + best] - total[place]
        found = np.flatnonzero((matched >= LENGTH) & (names >= 0))
        self.results.append((names[found], columns[found], columns[found] + matched[found]))

    def found(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self._run()
        return self.results


def _shared(parts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row, the longest prefix that it shares with another row; rows end at their lengths."""
    count, width = parts.shape
    if not width:
        return np.zeros(count, np.int64)
    order = np.array(sorted(range(count), key=[row.tobytes() for row in parts].__getitem__), np.int64)
    a, b = parts[order[:-1]], parts[order[1:]]
    same = a == b
    first = np.where(same.all(1), width, same.argmin(1))
    first = np.minimum(first, np.minimum(lengths[order[:-1]], lengths[order[1:]]))
    out = np.zeros(count, np.int64)
    np.maximum.at(out, order[:-1], first)
    np.maximum.at(out, order[1:], first)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: its bytes, how many in how many runs were removed, and the digest of the others.

    Defined results: a null text is empty; a text shorter than LENGTH keeps all; rows without an id and rows that repeat an
    id are judged like any other; an empty table gives no rows.
    """
    texts = texts_of(docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"].array, batch["text"], batch["spans"], strict=True):
                starts, ends = unpacked(spans)
                digest, at = hashlib.sha256(), 0
                for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(text[at:start])
                    at = end
                digest.update(text[at:])
                rows.append((doc_id, len(text), int((ends - starts).sum()), len(starts), digest.hexdigest()))
            columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return with_spans(texts, repeated_strings(texts)).mapInPandas(cut, schema)
