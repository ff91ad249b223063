"""The registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdwatch.llm import (
    alignment,
    collocations,
    decontamination,
    knn,
    language,
    packing,
    pii,
    repeats,
    sharding,
    signature_join,
    simhash,
    substrings,
    token_files,
)
from pdwatch.llm.common import table
from pdwatch.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def op1_voronoi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return knn.voronoi_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op2_hypergeometric_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_pigeonring_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_positional_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("digest")


def op5_linear_grouping_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op6_binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, folder, "documents"), path, keeps_space=True)


def op7_count_min_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, folder, "documents"))


def op8_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents")).drop("found")


def op9_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op10_wavelet_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.token_files(table(spark, folder, "documents"), path, keeps_space=False)


def op11_collocation_automata(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_identity_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_tokenizers(table(spark, folder, "documents"), *paths)


def op13_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, folder, "documents"))


def _shipped(query: Query) -> Query:
    """The query, with the package sent to the workers first."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


_QUERIES: dict[str, Query] = {
    "op1_voronoi_top_k": op1_voronoi_top_k,
    "op2_hypergeometric_sharding": op2_hypergeometric_sharding,
    "op3_pigeonring_simhash": op3_pigeonring_simhash,
    "op4_positional_decontamination": op4_positional_decontamination,
    "op5_linear_grouping_repeats": op5_linear_grouping_repeats,
    "op6_binary_packing": op6_binary_packing,
    "op7_count_min_substrings": op7_count_min_substrings,
    "op8_weak_supervision_pii": op8_weak_supervision_pii,
    "op9_language_mixture": op9_language_mixture,
    "op10_wavelet_token_files": op10_wavelet_token_files,
    "op11_collocation_automata": op11_collocation_automata,
    "op12_identity_alignment": op12_identity_alignment,
    "op13_signature_join": op13_signature_join,
}

QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

#: SQL that a result must agree with, where SQL can express it.
ORACLE: dict[str, str] = {
    "op1_voronoi_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op11_collocation_automata": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL
        ), worded AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
        ), placed AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
        ), grams AS (
            SELECT lang, unnest(list_filter([
                [w[i]],
                CASE WHEN i + 1 <= len(w) THEN [w[i], w[i + 1]] END,
                CASE WHEN i + 2 <= len(w) THEN [w[i], w[i + 1], w[i + 2]] END], lambda x: x IS NOT NULL)) AS g
            FROM placed
        ), counts AS (
            SELECT lang, g, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, g
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len(g) = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= 10
        ), covered AS (
            SELECT DISTINCT c.lang, c.g FROM candidates c JOIN (
                SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a AS f FROM candidates WHERE len(g) = 3
            ) t ON t.lang = c.lang AND t.g = c.g WHERE 100 * t.f >= 50 * c.a
        ), cuts AS (
            SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidates c
            WHERE NOT EXISTS (SELECT 1 FROM covered d WHERE d.lang = c.lang AND d.g = c.g)
        ), scored AS (
            SELECT u.lang, u.g, u.a, u.k, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * u.a * u.a // (x.f * y.f) AS score
            FROM cuts u JOIN counts x ON x.lang = u.lang AND x.g = u.g[1:u.k]
            JOIN counts y ON y.lang = u.lang AND y.g = u.g[u.k + 1:]
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        ), ranked AS (
            SELECT lang, array_to_string(g, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
                   CAST(r AS BIGINT) AS r, CAST(score AS BIGINT) AS score,
                   row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
            FROM lowest
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
