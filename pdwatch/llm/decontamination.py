"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

1. Count how often each benchmark term occurs in the corpus.
2. Order the terms of every benchmark window by rarity. The rarest one is the window's anchor.
3. Store the postings of the anchors: term, document, position and the words around it. A rare term has a short
   list, so the index is small beside the corpus.
4. Walk the windows of each posting's term: the list of the second rarest term, moved by its offset, must hold the
   position, then the whole phrase. For proximity matches the terms need only lie near the anchor in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow
from pdwatch.session import settle

WINDOW_WORDS = 10
#: Rows of benchmark terms or windows up to which they are sent to all executors; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: characters between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before the case is lowered: upper-case letters belong to words.
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words in their own case; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN_ANY_CASE), "")


def _ascii_lower(word: Column) -> Column:
    return F.translate(word, _UPPER, _UPPER.lower())


def _small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """`item_id`, `window` (its lower-cased words) for every window; an item shorter than one is one window."""
    words = narrow(items, item_id="item_id", text="text").select(
        F.col("item_id").cast("string").alias("item_id"), F.transform(_words(F.col("text")), _ascii_lower).alias("words")
    )
    words = words.where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select("item_id", F.slice("words", F.col("at") + 1, size).alias("window")).distinct()


def _fold(word: Column) -> Column:
    """A coarser key than the lower-cased word: full lower case, which needs no look-up per character.

    Words that are equal with A-Z lowered are equal here; the other direction is checked on the phrase.
    """
    return F.lower(word)


def _positions(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Every word of every document whose folded form is in `words` (`term`, ...), with its position from 0."""
    tokens = docs.select("doc_id", "digest", "words", F.posexplode("words").alias("at", "word"))
    tokens = tokens.withColumn("term", _fold(F.col("word")))
    return tokens.join(words, "term")


def rarity(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """`term`, `frequency`: occurrences of each term in all documents, none included."""
    found = docs.select(F.explode("words").alias("word")).select(_fold(F.col("word")).alias("term"))
    counts = found.join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("frequency"))


def anchored(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Windows with their terms in order of rarity: `term` and `before` of the rarest, the second likewise."""
    keyed = windows.withColumn("_key", F.struct("item_id", "window"))
    terms = keyed.select("_key", F.posexplode("window").alias("at", "word")).withColumn("term", _fold(F.col("word")))
    ranked = terms.join(frequencies, "term")
    order = Window.partitionBy("_key").orderBy("frequency", "term", "at")
    ranked = ranked.withColumn("_rank", F.row_number().over(order))
    rare = ranked.groupBy("_key").agg(
        F.min(F.when(F.col("_rank") == 1, F.struct("term", "at"))).alias("first"),
        F.min(F.when(F.col("_rank") == 2, F.struct("term", "at"))).alias("second"),
    )
    return rare.select(
        F.col("first.term").alias("term"),
        F.col("first.at").alias("before"),
        F.col("second.term").alias("second_term"),
        (F.col("second.at") - F.col("first.at")).alias("second_offset"),
        F.col("_key.item_id").alias("item_id"),
        F.col("_key.window").alias("window"),
    )


def store_postings(docs: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """The written index: one row for each place of an anchor term, with `reach` words to either side."""
    held = _positions(docs, _small(anchors.select("term").distinct()))
    first = F.greatest(F.col("at") - reach, F.lit(0))
    around = F.slice("words", first + 1, F.col("at") - first + reach + 1)
    return settle(
        held.select(
            "term", "doc_id", "digest", "at", (F.col("at") - first).alias("here"),
            F.transform(around, _ascii_lower).alias("around"),
        ),
        "postings",
    )


def phrase_matches(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Exact places of windows: `doc_id`, `digest`, `start`, `length`, `item_id`."""
    pairs = postings.join(_small(anchors), "term")
    in_around = F.col("here") - F.col("before")
    second = F.try_element_at("around", F.greatest(F.col("here") + F.col("second_offset"), F.lit(-1)) + 1)
    length = F.size("window")
    return (
        pairs.where(in_around >= 0)
        .where(F.col("second_term").isNull() | (F.col("here") + F.col("second_offset") >= 0))
        .where(F.col("second_term").isNull() | (_fold(second) == F.col("second_term")))
        .where(F.slice("around", in_around + 1, length) == F.col("window"))
        .select("doc_id", "digest", (F.col("at") - F.col("before")).alias("start"), length.alias("length"), "item_id")
    )


def proximity_matches(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places of an anchor with all words of its window within reach, in any order."""
    pairs = postings.join(_small(anchors), "term")
    near = F.size(F.array_except("window", "around")) == 0
    return pairs.where(near).select("doc_id", "digest", F.col("at").alias("anchor"), "item_id").distinct()


def indexed_documents(docs: DataFrame) -> DataFrame:
    """`doc_id`, the hash of its text (rows that repeat an id stay apart) and its words."""
    return narrow(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.xxhash64("text").alias("digest"), _words(F.col("text")).alias("words")
    )


def index_benchmark(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """The stored postings of the corpus and the anchored windows of the benchmark."""
    words = indexed_documents(docs)
    windows = benchmark_windows(items, size)
    terms = settle(windows.select(F.explode("window").alias("word")).select(_fold(F.col("word")).alias("term")).distinct(), "terms")
    anchors = settle(anchored(windows, settle(rarity(words, terms), "rarity")), "anchors")
    return store_postings(words, anchors, size - 1), anchors


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Per document: its words, words inside benchmark windows, and the items found.

    Defined results: a null or wordless text has no words; items without words match nothing; an item
    without an id marks words but is not listed; rows that repeat an id and text have the same result;
    an empty benchmark finds nothing.
    """
    postings, anchors = index_benchmark(docs, items, size)
    places = phrase_matches(postings, anchors)
    hits = (
        places.select("doc_id", "digest", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
        .distinct()
        .groupBy("doc_id", "digest")
        .agg(F.count("*").alias("n_hit"))
    )
    found = (
        places.select("doc_id", "digest", "item_id").distinct().groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    results = hits.join(
        found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "items"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")),
    ).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_hit", "items")
    sized = indexed_documents(docs).select("doc_id", "digest", F.size("words").cast("bigint").alias("n_words"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return sized.join(
        results, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left"
    ).select(
        "doc_id",
        "digest",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items_found), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, with all their columns."""
    bad = contamination(docs, items, size).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_digest"])
    return docs.join(bad, same, "left_anti")
