"""Language identification as inference in a mixture of languages.

Each language is a distribution over hashed letter n-grams, counted over all training documents. A document mixes
languages in unknown proportions: expectation-maximisation estimates them from the likelihoods of its
n-grams. Languages whose removal costs less likelihood than the penalty of a parameter are removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow

#: Letters per n-gram, a word's beginning and end counting as one.
GRAM = 3
#: Hashed n-grams per language: the size of the model is this number times the number of languages.
BUCKETS = 1 << 16
SMOOTHING = 0.5
ITERATIONS = 30
TOLERANCE = 1e-3
UNKNOWN = "und"
#: Code points that are looked at together; longer texts are counted in parts.
_PART = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(n).isalpha() for n in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the n-grams of a whole text and their counts; none if it has no letter."""
    total: np.ndarray | None = None
    text = text or ""
    for start in range(0, len(text), _PART):
        # Parts overlap, so that the n-grams across a cut are counted once.
        lowered = text[max(start - GRAM + 1, 0) : start + _PART].lower()
        points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(_is_letter()[points], points, 0).astype(np.uint64)
        if not start:
            points = np.concatenate([[0], points]).astype(np.uint64)
        if start + _PART >= len(text):
            points = np.concatenate([points, [0]]).astype(np.uint64)
        # A run of other characters is one border.
        if len(points) > 1:
            points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
        if len(points) < GRAM:
            continue
        hashed = np.zeros(len(points) - GRAM + 1, np.uint64)
        for offset in range(GRAM):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + points[offset : len(points) - GRAM + 1 + offset] + np.uint64(1)
        middle = points[1 : len(points) - GRAM + 2] != 0
        buckets = (hashed[middle] >> np.uint64(40)).astype(np.int64) % BUCKETS
        if total is None and len(text) <= _PART:
            return np.unique(buckets, return_counts=True)
        total = np.bincount(buckets, minlength=BUCKETS) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


class MixtureModel:
    """Log-likelihoods of all buckets in each language, and inference for one document."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smoothed = counts + SMOOTHING
        self.likelihood = smoothed / smoothed.sum(axis=1, keepdims=True) if languages else smoothed

    def proportions(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages chosen by penalised likelihood; zero for all others."""
        likelihood = self.likelihood[:, buckets]
        total = int(counts.sum())
        penalty = 0.5 * math.log(max(total, 2))
        chosen = np.arange(len(self.languages))
        shares, fit = _mix(likelihood, counts)
        while len(chosen) > 1:
            # The smallest share goes first; one that is small enough cannot pay for its parameter.
            weakest = int(shares.argmin())
            kept = np.delete(chosen, weakest)
            less, less_fit = _mix(likelihood[kept], counts)
            if fit - less_fit > penalty:
                break
            chosen, shares, fit = kept, less, less_fit
        out = np.zeros(len(self.languages))
        out[chosen] = shares
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the largest proportion, ties to the first by name, and that proportion."""
        buckets, counts = gram_counts(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        shares = self.proportions(buckets, counts)
        best = int(shares.argmax())
        return self.languages[best], float(min(max(shares[best], 0.0), 1.0))


def _mix(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the mixture; the shares and the log-likelihood."""
    languages = len(likelihood)
    shares = np.full(languages, 1 / languages)
    if languages == 1:
        return shares, float(counts @ np.log(likelihood[0]))
    total = counts.sum()
    for _ in range(ITERATIONS):
        mixed = shares @ likelihood
        new = shares * (likelihood @ (counts / mixed)) / total
        moved = np.abs(new - shares).max()
        shares = new
        if moved < TOLERANCE:
            break
    return shares, float(counts @ np.log(shares @ likelihood))


def held_out() -> Column:
    """Documents not learned from: those whose id's checksum leaves the remainder 2. A row without an id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame) -> MixtureModel:
    """Count the n-grams of every document of `labelled` (`text`, `lang`) by language.

    Every partition sums its documents to one row per language, so the shuffle carries that much and the driver gets
    one row of BUCKETS counts per language. Rows without a language or text teach nothing.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if lang is None:
                    continue
                buckets, counts = gram_counts(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += counts
        for lang, held in sums.items():
            yield pd.DataFrame({"lang": [lang], "counts": [_pack(held)]})

    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in rows:
            for lang, packed in zip(batch["lang"], batch["counts"], strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(packed, "<i8")
        for lang, held in sums.items():
            yield pd.DataFrame({"lang": [lang], "counts": [_pack(held)]})

    schema = "lang string, counts binary"
    per_partition = labelled.select("text", "lang").where("lang is not null").mapInPandas(count, schema)
    # Two levels: partitions are added up in a few tasks first, and these sums by language.
    some = per_partition.repartition(16, F.xxhash64("counts")).mapInPandas(add, schema)
    summed = some.repartition("lang").mapInPandas(add, schema)
    rows = sorted((lang, np.frombuffer(packed, "<i8")) for lang, packed in summed.collect())
    return MixtureModel([lang for lang, _ in rows], np.array([held for _, held in rows]).reshape(len(rows), BUCKETS))


def _pack(counts: np.ndarray) -> bytes:
    return counts.astype("<i8").tobytes()


def predict(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` for each row; `und` and 0 without a letter or without a model."""

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.predict(text) for text in batch["text"]]
            yield batch[["doc_id", "held_out"]].assign(
                doc_id=batch["doc_id"].astype("Int64"), lang_pred=[x for x, _ in found], score=[x for _, x in found]
            )

    rows = narrow(docs, doc_id="doc_id", text="text").withColumn("held_out", held_out())
    return rows.mapInPandas(guess, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows of `docs` that are not held out, and predict all rows."""
    labelled = narrow(docs, doc_id="doc_id", text="text", lang="lang").where(~held_out())
    return predict(docs, train(labelled))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language. A text without letters has none.

    Where no language can be learned, for want of labelled rows that are not held out, every text with a letter stays.
    """
    model = train(narrow(docs, doc_id="doc_id", text="text", lang="lang").where(~held_out()))

    @F.pandas_udf("boolean")
    def has_language(texts: pd.Series) -> pd.Series:
        if not model.languages:
            return texts.map(lambda text: len(gram_counts(text)[0]) > 0).astype(bool)
        return texts.map(lambda text: model.predict(text)[0] != UNKNOWN).astype(bool)

    return docs.where(has_language(docs["text"]))
