"""Removal of word sequences that an earlier document has, with a count-min prefilter.

The first pass counts every window of words in a sketch. The second looks only at windows whose estimate says that
they are in two documents, and groups these exactly. An estimate is never too small, so no window is lost.
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

WINDOW = 13
#: Text bytes of a chunk. A chunk sends a window once, so larger ones send less and hold more.
CHUNK_BYTES = 12 << 20
#: Windows per shard that the number of shards is chosen for.
SHARD_WINDOWS = 1 << 20
#: Bytes of a word and the space after it that the number of windows is guessed from; it sets sizes, no result.
_WORD_BYTES = 6

_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_ENTRY = np.dtype([("key", "<u8"), ("check", "<u4"), ("least", "<i8")])


def window_hash(values: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every `size` consecutive values, put together from doubled lengths."""
    with np.errstate(over="ignore"):
        out, length, start, power, doubled = None, 1, 0, base, values
        rest = size
        while rest:
            if rest & 1:
                part = doubled[start:]
                out = part if out is None else out[: len(part)] * power + part
                start += length
            rest >>= 1
            if rest:
                doubled = doubled[:-length] * power + doubled[length:] if len(doubled) > length else doubled[:0]
                power = power * power
                length *= 2
        return out[: max(len(values) - size + 1, 0)]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of words of each text."""
    lengths, parts = np.zeros(len(texts), np.int64), []
    for place, text in enumerate(texts):
        words = text.split()
        lengths[place] = len(words)
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), lengths


class _Windows:
    """The windows of a chunk in documents with an id, sorted by hash."""

    def __init__(self, chunk: Chunk, size: int) -> None:
        values, self.lengths = word_hashes(chunk.texts)
        docs = np.repeat(np.arange(len(chunk.texts), dtype=np.int32), self.lengths)
        self.key = window_hash(values, size, _FIRST)
        count = len(self.key)
        self.at = np.flatnonzero((docs[:count] == docs[size - 1 : size - 1 + count]) & ~chunk.unknown[docs[:count]])
        self.key, self.values, self.size = self.key[self.at], values, size
        self.ids = chunk.doc_ids[docs[self.at]]

    def keep(self, mask: np.ndarray) -> None:
        self.at, self.key, self.ids = self.at[mask], self.key[mask], self.ids[mask]

    def sort(self) -> None:
        order = np.argsort(self.key, kind="stable")
        self.at, self.key, self.ids = self.at[order], self.key[order], self.ids[order]


def _count(bits: int, size: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, CHUNK_BYTES):
            windows = _Windows(chunk, size)
            windows.sort()
            if not len(windows.key):
                continue
            # A window counts once for each document of the chunk that has it: its places in one document are neighbours.
            fresh = np.concatenate([[True], windows.key[1:] != windows.key[:-1]])
            other = fresh | np.concatenate([[True], windows.ids[1:] != windows.ids[:-1]])
            starts = np.flatnonzero(fresh)
            yield from sketch.partial(windows.key[starts], np.add.reduceat(other, starts, dtype=np.int64), bits)

    return count


def repeated_windows(texts: DataFrame, size: int) -> DataFrame:
    """Spans of words in windows that start in a document with a smaller id too."""
    total = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // _WORD_BYTES
    bits = sketch.bits_for(total)
    shards = max(64, total // SHARD_WINDOWS)
    maps = sketch.merged(texts.mapInPandas(_count(bits, size), sketch.SCHEMA), bits, [2])
    shared = texts.sparkSession.sparkContext.broadcast(maps[0])

    def prepare(chunk: Chunk) -> tuple[dict[int, bytes], bytes]:
        windows = _Windows(chunk, size)
        windows.keep(sketch.at_least(windows.key, shared.value, bits))
        windows.sort()
        check = (window_hash(windows.values, size, _SECOND) >> np.uint64(32)).astype("<u4")[windows.at]
        if not len(check):
            return {}, packed(windows.lengths, *[np.zeros(0, "<i8")] * 4)
        key = windows.key
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        starts = np.flatnonzero(fresh)
        entry = np.cumsum(fresh) - 1
        table = np.zeros(len(starts), _ENTRY)
        table["key"], table["check"] = key[starts], check[starts]
        table["least"] = np.minimum.reduceat(windows.ids, starts)
        shard = (table["key"] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        questions = {
            number: table[low:high].tobytes()
            for number, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            if high > low
        }
        # Against the chunk's own smallest id the answer is known; an earlier document elsewhere removes all places.
        own = windows.ids > table["least"][entry]
        counts = np.diff(np.append(starts, len(entry)))
        sizes = np.diff(cuts).astype("<i8")
        return questions, packed(windows.lengths, sizes, counts.astype("<i8"), windows.at.astype("<u4"), own)

    def resolve(_: int, questions: list[bytes]) -> list[bytes]:
        tables = [np.frombuffer(data, _ENTRY) for data in questions]
        every = np.concatenate(tables)
        order = np.lexsort((every["check"], every["key"]))
        held = every[order]
        fresh = np.concatenate([[True], (held["key"][1:] != held["key"][:-1]) | (held["check"][1:] != held["check"][:-1])])
        least = np.minimum.reduceat(held["least"], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        earlier = np.zeros(len(every), bool)
        earlier[order] = held["least"] > least
        ends = np.cumsum([len(table) for table in tables])
        return [np.packbits(earlier[end - len(table) : end]).tobytes() for table, end in zip(tables, ends, strict=True)]

    def finish(notes: bytes, answers: dict[int, bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lengths, sizes, counts, at, own = arrays(notes, "<i8", "<i8", "<i8", "<u4", "?")
        earlier = answered(sizes, answers)
        removed = at[own | np.repeat(earlier, counts)].astype(np.int64)
        yield from spans_by_document(removed, removed + size, lengths)

    return spans_of_documents(texts, CHUNK_BYTES, prepare, resolve, finish)


def answered(sizes: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The bits that the shards answered with, for all entries of a chunk in order."""
    asked = np.flatnonzero(sizes)
    if set(asked.tolist()) != set(answers):
        raise ValueError("a chunk was prepared differently in its two passes")
    bits = [np.unpackbits(np.frombuffer(answers[n], np.uint8), count=int(sizes[n])) for n in asked.tolist()]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def spans_by_document(
    starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Union of intervals over the joined documents of a chunk, as maximal runs inside each document."""
    if not len(starts):
        return
    order = np.argsort(starts, kind="stable")
    first, reach = starts[order], np.maximum.accumulate(ends[order])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = np.searchsorted(offsets[1:], first, side="right")
    # Intervals never leave their document; those that touch in one document are one run.
    opens = np.flatnonzero(np.concatenate([[True], (first[1:] > reach[:-1]) | (place[1:] != place[:-1])]))
    closes = np.append(opens[1:], len(first)) - 1
    run_place, run_first, run_last = place[opens], first[opens], reach[closes]
    cuts = np.flatnonzero(np.concatenate([[True], run_place[1:] != run_place[:-1], [True]]))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        doc = int(run_place[low])
        yield doc, run_first[low:high] - offsets[doc], run_last[low:high] - offsets[doc]


def remove_repeated(docs: DataFrame, size: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document: its words, how many were removed, and the digest of the kept ones (`with_text`: and these).

    Defined results: a null text has no words; a text shorter than a window keeps all; rows that share an id do not remove
    from one another, and rows without an id neither remove nor lose anything; an empty table gives no rows.
    """
    texts = texts_of(docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"].array, batch["text"], batch["spans"], strict=True):
                words = text.split()
                kept, at, removed = [], 0, 0
                for start, end in zip(*(x.tolist() for x in unpacked(spans)), strict=True):
                    kept.extend(words[at:start])
                    at, removed = end, removed + end - start
                kept.extend(words[at:])
                joined = b" ".join(kept)
                row = (doc_id, len(words), removed, hashlib.sha256(joined).hexdigest())
                rows.append((*row, joined.decode("utf-8", "replace")) if with_text else row)
            columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return with_spans(texts, repeated_windows(texts, size)).mapInPandas(cut, schema)
