"""Tokens of a corpus in wavelet matrix files, written in order of document ids and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow
from pdwatch.llm.tokens import encoder
from pdwatch.llm.wavelet import WaveletMatrix
from pdwatch.session import staging_path

#: Tokens after which a file is closed. A longer document makes a longer file.
FILE_TOKENS = 1 << 20
END_ID = 1

_FILES = "part int, file int, doc_ids array<bigint>, lengths array<bigint>, matrix binary"
_READ = "part int, file int, in_file bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, keeps_space: bool, end_id: int = END_ID, file_tokens: int = FILE_TOKENS
) -> None:
    """Encode every text, cut the corpus into files in ascending `doc_id` order, and write them.

    A null text is empty; each document gets `end_id`. Rows without an id come first; rows that share
    an id follow each other in order of their text's hash. A row of the table at `path` is one file: the
    ids and lengths of its documents and the matrix.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_text = encoder(tokenizer, keeps_space).encode
        part, file = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0
        end = np.array([end_id], encoder(tokenizer, keeps_space).dtype)

        def close() -> pd.DataFrame:
            lengths = [len(item) + 1 for item in ids]
            joined = np.concatenate([item for pair in ids for item in (pair, end)])
            matrix = WaveletMatrix.from_ids(joined).to_bytes()
            row = [(part, file, names, lengths, matrix)]
            return pd.DataFrame(row, columns=["part", "file", "doc_ids", "lengths", "matrix"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                ids.append(encode_text(text or ""))
                names.append(None if pd.isna(doc_id) else int(doc_id))
                held += len(ids[-1]) + 1
                if held >= file_tokens:
                    yield close()
                    ids, names, held, file = [], [], 0, file + 1
        if ids:
            yield close()

    ordered = (
        narrow(docs, doc_id="doc_id", text="text")
        # Rows that share an id, or lack one, may be many: the hash splits them too.
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInPandas(encode, _FILES).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: its length, checksum, and the ids of all documents before it."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, file, doc_ids, lengths, matrix in batch.itertuples(index=False):
                ids = WaveletMatrix.from_bytes(matrix).ids().astype("<u4", copy=False)
                ends = np.cumsum(np.asarray(lengths, np.int64))
                sums = [
                    zlib.crc32(ids[end - length : end]) for end, length in zip(ends.tolist(), lengths, strict=True)
                ]
                yield pd.DataFrame(
                    {
                        "part": part,
                        "file": file,
                        "in_file": ends - np.asarray(lengths, np.int64),
                        "doc_id": pd.array(doc_ids, "Int64"),
                        "n_tokens": np.asarray(lengths, np.int64),
                        "ids_crc32": sums,
                    }
                )

    files = spark.read.schema(_FILES).parquet(path)
    # Offsets come from the small columns alone: of parts, of files in a part, of documents in a file.
    sizes = files.select(
        "part", "file", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n).alias("tokens")
    )
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    file_starts = (
        sizes.select("part", "file", F.coalesce(F.sum("tokens").over(in_part), F.lit(0)).alias("file_start"))
        .join(part_starts, "part")
        .select("part", "file", (F.col("part_start") + F.col("file_start")).alias("file_start"))
    )
    return (
        files.mapInPandas(decode, _READ)
        .join(file_starts, ["part", "file"])
        .select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_files(docs: DataFrame, tokenizer: str, keeps_space: bool) -> DataFrame:
    """Write the files of `docs` below the shared folder and read them back."""
    spark = docs.sparkSession
    path = staging_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, keeps_space)
    return read_token_files(spark, path)
