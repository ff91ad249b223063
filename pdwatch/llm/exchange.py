"""Questions of chunks of documents, answered by shards of the corpus, and brought back to the documents.

A chunk is a bounded run of documents in one task. It sends one packed question to each shard that its keys fall
into, so equal keys of all chunks meet in one shard, once per chunk however often they occur. The shards'
answers return to the chunk, which turns them into spans of its documents.

A chunk is prepared twice, for its questions and for its own notes, instead of being stored. Both passes read the same
partitions in the same order; the notes name the number of keys and a differing answer is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow, release_memory, utf8

#: Questions that are handed to Spark together.
_SENT = 32

_ROWS = "part int, chunk int, shard int, data binary"
_SPANS = "doc_id bigint, digest bigint, spans binary"


@dataclass
class Chunk:
    part: int
    doc_ids: np.ndarray  # of int64; unknown ids are marked
    unknown: np.ndarray
    digests: np.ndarray
    texts: list[bytes]


def texts_of(docs: DataFrame) -> DataFrame:
    """`doc_id`, `digest`, `text` as bytes, `part` of the scan. Rows that repeat an id with another text differ in the digest."""
    rows = narrow(docs, doc_id="doc_id", text="text")
    text = utf8(F.col("text")).alias("text")
    return rows.select("doc_id", F.xxhash64("text").alias("digest"), text, F.spark_partition_id().alias("part"))


def chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[Chunk]:
    """Runs of documents of at most `size` text bytes; one longer text is a chunk of its own."""
    ids: list = []
    digests: list[int] = []
    texts: list[bytes] = []
    held, part = 0, -1

    def made() -> Chunk:
        release_memory()
        unknown = np.array([pd.isna(x) for x in ids], bool)
        known = np.array([0 if no else int(x) for x, no in zip(ids, unknown, strict=True)], np.int64)
        return Chunk(part, known, unknown, np.array(digests, np.int64), texts)

    for batch in batches:
        part = int(batch["part"].iloc[0]) if len(batch) else part
        for doc_id, digest, text in zip(batch["doc_id"].array, batch["digest"], batch["text"], strict=True):
            if texts and held + len(text) > size:
                yield made()
                ids, digests, texts, held = [], [], [], 0
            ids.append(doc_id)
            digests.append(digest)
            texts.append(text)
            held += len(text)
    if texts:
        yield made()


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([array.nbytes for array in arrays], "<i8")
    return head.tobytes() + b"".join(array.tobytes() for array in arrays)


def arrays(data: bytes, *dtypes: str) -> list[np.ndarray]:
    at, out = 8 * len(dtypes), []
    for dtype, length in zip(dtypes, np.frombuffer(data, "<i8", len(dtypes)).tolist(), strict=True):
        out.append(np.frombuffer(data, dtype, length // np.dtype(dtype).itemsize, at))
        at += length
    return out


def spans_of_documents(
    texts: DataFrame,
    size: int,
    prepare: Callable[[Chunk], tuple[dict[int, bytes], bytes]],
    resolve: Callable[[int, list[bytes]], list[bytes]],
    finish: Callable[[bytes, dict[int, bytes]], Iterator[tuple[int, np.ndarray, np.ndarray]]],
) -> DataFrame:
    """`doc_id`, `digest`, `spans` (packed starts and ends) of documents that have spans.

    Chunks have `size` bytes. `prepare` gives the questions by shard and the notes of a chunk; `resolve` answers all questions of a shard (by its number);
    `finish` yields for documents of the chunk (by place) the starts and ends.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, chunk in enumerate(chunks(batches, size)):
            questions = list(prepare(chunk)[0].items())
            for start in range(0, len(questions), _SENT):
                shards, data = zip(*questions[start : start + _SENT], strict=True)
                yield pd.DataFrame({"part": chunk.part, "chunk": number, "shard": shards, "data": data})

    def note(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, chunk in enumerate(chunks(batches, size)):
            names = b"".join(
                [np.int64(len(chunk.texts)).tobytes(), chunk.doc_ids.tobytes(), chunk.unknown.tobytes(), chunk.digests.tobytes()]
            )
            notes = prepare(chunk)[1]
            data = np.int64(len(names)).tobytes() + names + notes
            yield pd.DataFrame({"part": [chunk.part], "chunk": [number], "shard": [-1], "data": [data]})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        return group[["part", "chunk", "shard"]].assign(data=resolve(int(group["shard"].iloc[0]), list(group["data"])))

    def end(group: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        answers = {shard: data for shard, data in zip(group["shard"], group["data"], strict=True)}
        data = answers.pop(-1)
        length = int(np.frombuffer(data, np.int64, 1)[0])
        count = int(np.frombuffer(data, np.int64, 1, 8)[0])
        doc_ids = np.frombuffer(data, np.int64, count, 16)
        unknown = np.frombuffer(data, bool, count, 16 + 8 * count)
        digests = np.frombuffer(data, np.int64, count, 16 + 9 * count)
        rows = []
        for place, starts, ends in finish(data[8 + length :], answers):
            name = None if unknown[place] else int(doc_ids[place])
            rows.append((name, int(digests[place]), np.stack([starts, ends]).astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "digest", "spans"]).astype({"doc_id": "Int64", "digest": "int64"})

    answers = texts.mapInPandas(ask, _ROWS).groupBy("shard").applyInPandas(answer, _ROWS)
    notes = texts.mapInPandas(note, _ROWS)
    found = answers.unionByName(notes).groupBy("part", "chunk").applyInPandas(end, _SPANS)
    # Rows equal in id and text have equal spans.
    return found.dropDuplicates(["doc_id", "digest"])


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with its spans, null if it has none."""
    named = spans.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return texts.join(named, same, "left").select("doc_id", "text", "spans")


def unpacked(spans: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if spans is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(spans, "<i8")
    return both[: len(both) // 2], both[len(both) // 2 :]
