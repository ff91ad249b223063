"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths.

A document of n tokens gives as many whole contexts as fit and one piece for each binary digit of the
rest. Every piece is a sequence of its own and equal lengths share a bucket, so a sequence never
crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow, release_memory
from pdwatch.llm.tokens import encoder
from pdwatch.session import settle

CONTEXT = 2048
END_ID = 1
#: Documents that a worker holds as texts, with their pieces, at once.
HELD_ROWS = 1000
#: Sequences that one task numbers.
NUMBERED_ROWS = 1 << 18

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def binary_lengths(tokens: int, context: int) -> list[int]:
    """Lengths of the pieces of a document, longest first; `context` is a power of two."""
    whole, rest = divmod(tokens, context)
    digits = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    return [context] * whole + digits


def pieces(
    docs: DataFrame, tokenizer: str, keeps_space: bool, context: int = CONTEXT, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Every piece of every document: where it starts, its length and the checksum of its ids.

    A null text is empty, so such a document is the one piece of its end id. Rows without an id and rows
    that repeat an id are cut like any other. `with_ids` adds the ids, little-endian unsigned 32-bit.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")

    fields = [pa.field(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = pa.schema([*fields, *[pa.field("ids", pa.binary())] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_space).encode
        for batch in batches:
            for first in range(0, batch.num_rows, HELD_ROWS):
                held = batch.slice(first, HELD_ROWS)
                rows = []
                for doc_id, text in zip(held["doc_id"].to_pylist(), held["text"].to_pylist(), strict=True):
                    encoded = encode(text or "")
                    start, total = 0, len(encoded) + 1
                    ids = np.full(total, end_id, "<u4")
                    ids[:-1] = encoded
                    for length in binary_lengths(total, context):
                        part = ids[start : start + length]
                        row = (doc_id, start, length, zlib.crc32(part), total)
                        rows.append((*row, part.tobytes()) if with_ids else row)
                        start += length
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        release_memory()

    return narrow(docs, doc_id="doc_id", text="text").mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def number_sequences(cut: DataFrame) -> DataFrame:
    """Give each piece a sequence number without gaps, bucket after bucket, longest first.

    Inside a bucket the order is by a hash, so that neighbours come from different documents. Numbers are
    counted in chunks of that hash, whose number follows the number of pieces.
    """
    total = cut.count()
    chunks = max(8, total // NUMBERED_ROWS)
    keyed = cut.withColumn("_mix", F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")).withColumn(
        "_chunk", F.pmod("_mix", F.lit(chunks))
    )
    counts = keyed.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc("length"), "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_chunk").orderBy("_mix", "doc_id", "start")
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["length", "_chunk"])
        .withColumn("sequence_id", F.col("_first") + F.col("_row") - 1)
        .withColumn("offset", F.lit(0).cast("bigint"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """Cut all documents and number the sequences. The cut pieces are written once: encoding is the costly part."""
    return number_sequences(settle(pieces(docs, tokenizer, keeps_space, context, end_id), "pieces"))
