"""Personal data in texts: exact patterns, and weak labelers whose reliabilities are estimated.

Spans of the four base kinds are facts and always stay. Looser candidates (national phone numbers, identity numbers,
bank accounts, spelled-out addresses) are judged: a regular-expression, a gazetteer, a context and a shape labeler vote on
base spans and candidates alike; expectation-maximisation estimates how reliable each vote is; its posteriors train
a naive Bayes classifier on features of the span, and candidates above its threshold are added.

All of this is DataFrame functions. The driver sees counts by vote pattern and by feature value, a few hundred rows
whatever the corpus.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.llm.common import free_name, narrow

KINDS = ("email", "ip", "card", "phone")
ADDED_KIND = "other"
#: Probability from which a candidate is added.
THRESHOLD = 0.9
ROUNDS = 50
#: Characters before a span that the context labeler reads.
CONTEXT = 32

# The base patterns. Runs are possessive and begin where no character of the run stands before, or where
# the last match ended, so that a long run is read once.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a span of the kind.
_NEEDED = {"email": "@", "ip": ".", "phone": "+"}
# Bank accounts are written in groups of four with a shorter last one. A last group after a space holds a digit, else it may
# be the next word; only the accounts of two countries end in letters.
_ACCOUNT = (
    r"(?:MU|SC)[0-9]{2}(?: ?[A-Z0-9]{4}){6} ?[A-Z0-9]{2,3}"
    r"|[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}| (?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?"
    r"|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})"
)
# National numbers: American; French; Spanish; German and British with an area code.
_NATIONAL = (
    r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|0[1-9](?:[ .-]?[0-9]{2}){4}"
    r"|[6-9][0-9]{2}(?:[ -]?[0-9]{3}){2}|[89][0-9]{2}(?:[ .-][0-9]{2}){3}|9[0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2}"
    r"|(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}(?: ?/ ?|[ -]))"
    r"(?:[0-9]{2,3}(?:[ -][0-9]{2,3}){2,3}|[0-9]{5,8}(?:-[0-9]{1,4})?|[0-9]{3,4}[ -][0-9]{3,5})"
    r"|0[1-9][0-9]{8,10}"
)
_CANDIDATE = (
    rf"(?<![0-9A-Za-z+])(?:{_NATIONAL}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}"
    rf"|{_ACCOUNT}|[A-Za-z0-9._%+-]{{1,64}}+ ?[\[(]at[\])] ?[A-Za-z0-9.-]{{3,64}})(?![0-9A-Za-z])"
)
# The gazetteer of endings and prefixes, and the cues of the context labeler.
_ENDINGS = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|it|nl|uk|eu)$"
_PREFIXES = r"^(?:\+(?:1|33|34|39|44|49)[^0-9]|(?:DE|FR|ES|GB|IT|NL)[0-9]{2})"
_FOR = (
    r"(?i)(?:e-?mail|mail|contact|call|phone|t[eé]l|mobile|fax|card|iban|account|ssn|passport|address|reach"
    r"|handy|portable|m[oó]vil|konto|compte|cuenta)[^\n]{0,12}$"
)
_AGAINST = r"(?i)(?:isbn|version|page|figure|section|order|item|build|serial|part)[^\n]{0,12}$"
_BLOCK = 1024


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match starts: running sums, in blocks so that the cost stays in proportion to the matches."""
    steps = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: (
            F.char_length(F.get(gaps, i)) + F.coalesce(F.char_length(F.get(found, i - 1)), F.lit(0))
        ).cast("bigint"),
    )
    empty = F.array().cast("array<bigint>")

    def block(state: Column, number: Column) -> Column:
        before = F.coalesce(F.get(state, F.size(state) - 1)["total"], F.lit(0).cast("bigint"))
        inner = F.aggregate(
            F.slice(steps, number * _BLOCK + 1, _BLOCK),
            F.struct(before.alias("total"), empty.alias("starts")),
            lambda a, step: F.struct(
                (a["total"] + step).alias("total"), F.concat(a["starts"], F.array(a["total"] + step)).alias("starts")
            ),
        )
        return F.concat(state, F.array(inner))

    blocks = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")),
        F.array().cast("array<struct<total:bigint,starts:array<bigint>>>"),
        block,
    )
    return F.flatten(F.transform(blocks, lambda b: b["starts"]))


_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def _find(text: Column, pattern: str, kind: str, rank: int, needed: str | None) -> Column:
    """All leftmost matches that do not overlap, with their places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = _starts(F.split(text, pattern, -1), found)
    spans = F.zip_with(
        starts,
        found,
        lambda start, value: F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            (start + F.char_length(value)).alias("end"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
        ),
    )
    none = F.array().cast(_SPANS)
    some = F.when(F.size(found) > 0, spans).otherwise(none).cast(_SPANS)
    return some if needed is None else F.when(F.contains(text, F.lit(needed)), some).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether at most 20 digits pass the check; leading zeros do not change it."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for place in range(20):
        digit = F.substring(padded, 20 - place, 1).cast("int")
        doubled = 2 * digit
        total = total + (digit if place % 2 == 0 else F.when(doubled > 9, doubled - 9).otherwise(doubled))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    length = F.length(digits)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda part: F.ltrim(part, F.lit("0")))
        return F.forall(parts, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))
    if kind == "card":
        return F.when(length.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return length.between(10, 15)
    return F.lit(True)


def _one_argument(function: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    return lambda span: function(kind, span)


def _is_valid(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def base_spans(text: Column) -> Column:
    """The valid spans of the base kinds, by start and then kind. A null text has none."""
    whole = F.coalesce(text, F.lit(""))
    kinds = []
    for rank, kind in enumerate(KINDS):
        found = _find(whole, _PATTERNS[kind], kind, rank, _NEEDED.get(kind))
        kinds.append(F.filter(found, _one_argument(_is_valid, kind)))
    return F.array_sort(F.concat(*kinds))


def _looser(text: Column, base: Column) -> Column:
    """Candidates that touch no base span, or hold it as a part: an account may hold what passes as a card."""
    found = _find(F.coalesce(text, F.lit("")), _CANDIDATE, ADDED_KIND, len(KINDS), None)

    def clash(b: Column, c: Column) -> Column:
        touches = (b["start"] < c["end"]) & (c["start"] < b["end"])
        inside = (c["start"] <= b["start"]) & (b["end"] <= c["end"]) & (b["end"] - b["start"] < c["end"] - c["start"])
        return touches & ~inside

    return F.filter(found, lambda c: ~F.exists(base, lambda b: clash(b, c)))


def _context(text: Column, start: Column) -> Column:
    first = F.greatest(start - CONTEXT, F.lit(0).cast("bigint"))
    return F.substring(text, (first + 1).cast("int"), (start - first).cast("int"))


def _votes(span: Column, before: Column) -> dict[str, Column]:
    """One vote of each labeler: 1 for, 0 against, null to abstain."""
    value = span["value"]
    digits = F.length(_digits(value))
    account = F.regexp_like(value, F.lit("^[A-Z]{2}[0-9]{2}")) & F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34)
    return {
        "pattern": F.when(span["kind"] != ADDED_KIND, 1),
        "gazetteer": F.when(F.regexp_like(value, F.lit(_ENDINGS)) | F.regexp_like(value, F.lit(_PREFIXES)), 1),
        "context": F.when(F.regexp_like(before, F.lit(_FOR)), 1).when(F.regexp_like(before, F.lit(_AGAINST)), 0),
        "shape": F.when(F.contains(value, F.lit("@")) | digits.between(7, 19) | account, 1).otherwise(0),
    }


def _features(span: Column, before: Column) -> dict[str, Column]:
    value = span["value"]
    return {
        "digits": F.least(F.length(_digits(value)), F.lit(20)).cast("string"),
        "separators": F.least(F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")), F.lit(8)).cast("string"),
        "letters": F.regexp_like(value, F.lit("[A-Za-z]")).cast("string"),
        "first": F.regexp_replace(F.regexp_replace(F.substring(value, 1, 1), "[0-9]", "0"), "[A-Za-z]", "a"),
        "cue": F.regexp_like(before, F.lit(_FOR)).cast("string"),
        "counter": F.regexp_like(before, F.lit(_AGAINST)).cast("string"),
    }


_LABELERS = ("pattern", "gazetteer", "context", "shape")
_FEATURES = ("digits", "separators", "letters", "first", "cue", "counter")


def estimate(patterns: list[tuple[tuple[int | None, ...], int]]) -> dict[tuple[int | None, ...], float]:
    """Posterior of each vote pattern, by expectation-maximisation over the counts of the patterns.

    A labeler has a rate of each vote (for, against, abstain) in either class. The start is the share of votes
    for; a pattern without any vote starts at one half.
    """
    posterior = {}
    for votes, _ in patterns:
        cast = [vote for vote in votes if vote is not None]
        posterior[votes] = 0.1 + 0.8 * sum(cast) / len(cast) if cast else 0.5
    for _ in range(ROUNDS):
        weight = {1: 1.0, 0: 1.0}
        rates: dict[tuple[int, int, int | None], float] = {}
        for votes, count in patterns:
            for label, share in ((1, posterior[votes]), (0, 1 - posterior[votes])):
                weight[label] += share * count
                for labeler, vote in enumerate(votes):
                    rates[label, labeler, vote] = rates.get((label, labeler, vote), 1.0) + share * count
        total = weight[1] + weight[0]
        for votes in posterior:
            logs = []
            for label in (1, 0):
                terms = [rates.get((label, n, vote), 1.0) / (weight[label] + 2) for n, vote in enumerate(votes)]
                logs.append(math.log(weight[label] / total) + sum(map(math.log, terms)))
            posterior[votes] = 1 / (1 + math.exp(min(max(logs[1] - logs[0], -50.0), 50.0)))
    return posterior


def _prepared(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text`, `base`, `loose` for each row."""
    rows = narrow(docs, doc_id="doc_id", text="text").withColumn("base", base_spans(F.col("text")))
    return rows.withColumn("loose", _looser(F.col("text"), F.col("base")))


def train_classifier(prepared: DataFrame) -> dict[tuple[str, str], float]:
    """Log-odds of each feature value, and the prior under ("", ""). Empty if there is no candidate to judge."""
    spans = prepared.select("text", F.explode(F.concat("base", "loose")).alias("span"))
    spans = spans.withColumn("before", _context(F.col("text"), F.col("span.start")))
    votes, features = _votes(F.col("span"), F.col("before")), _features(F.col("span"), F.col("before"))
    table = spans.select(
        *[votes[name].alias(f"v_{name}") for name in _LABELERS], *[features[name].alias(f"f_{name}") for name in _FEATURES]
    )
    # All that is needed is how often each combination of votes and values occurs; both have few.
    counted = table.groupBy(*table.columns).agg(F.count("*").alias("n"))
    by_votes = [f"v_{name}" for name in _LABELERS]
    rows = counted.groupBy(*by_votes).agg(F.sum("n").alias("n")).collect()
    if not any(row["v_pattern"] is None for row in rows):
        return {}
    patterns = [(tuple(row[name] for name in by_votes), row["n"]) for row in rows]
    posterior = estimate(patterns)
    share = F.lit(0.5)
    for pattern, value in posterior.items():
        same = [F.col(name).eqNullSafe(F.lit(vote).cast("int")) for name, vote in zip(by_votes, pattern, strict=True)]
        share = F.when(same[0] & same[1] & same[2] & same[3], value).otherwise(share)
    weighed = counted.withColumn("share", share * F.col("n"))
    values = F.explode(
        F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"f_{name}").alias("value")) for name in _FEATURES])
    )
    sums = (
        weighed.select(values.alias("feature"), "share", "n")
        .groupBy("feature.name", "feature.value")
        .agg(F.sum("share").alias("yes"), F.sum("n").alias("n"))
        .collect()
    )
    yes = sum(posterior[pattern] * count for pattern, count in patterns)
    total = sum(count for _, count in patterns)
    no = total - yes
    odds = {("", ""): math.log((yes + 1) / (no + 1))}
    for name, value, with_value, count in sums:
        odds[name, value] = math.log((with_value + 1) / (yes + 2)) - math.log((count - with_value + 1) / (no + 2))
    return odds


def added_spans(text: Column, loose: Column, odds: dict[tuple[str, str], float]) -> Column:
    """The candidates that the classifier accepts."""
    if not odds:
        return F.filter(loose, lambda _: F.lit(False))
    table = F.create_map(*itertools.chain(*((F.lit(f"{a}={b}"), F.lit(value)) for (a, b), value in odds.items())))
    level = math.log(THRESHOLD / (1 - THRESHOLD))

    def accepted(span: Column) -> Column:
        features = _features(span, _context(text, span["start"]))
        score = F.lit(odds["", ""])
        for name in _FEATURES:
            score = score + F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{name}="), features[name])), F.lit(0.0))
        return score >= level

    return F.filter(loose, accepted)


def _written(spans: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: the base spans by kind, their digest, and all spans as text and as structs.

    Defined results: a null text is empty; rows without an id or with a repeated one are read like any other; an
    empty table gives no rows.
    """
    prepared = _prepared(docs)
    odds = train_classifier(prepared)
    found = prepared.withColumn("all", F.array_sort(F.concat("base", added_spans(F.col("text"), F.col("loose"), odds))))
    counts = [
        F.size(F.filter("base", _one_argument(_is_kind, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
        F.col("all").alias("found"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets, and `n_chars` of changed texts counted anew."""
    odds = train_classifier(_prepared(docs))
    text = docs["text"]
    base = base_spans(text)
    spans = F.array_sort(F.concat(base, added_spans(text, _looser(text, base), odds)))
    held, new = free_name(docs, "_spans"), free_name(docs, "_text")
    marked = docs.withColumn(held, spans)

    def replace(state: Column, span: Column) -> Column:
        # A span that overlaps the one before only carries its end on.
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        more = F.array(gap, F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">")))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] >= state["at"], F.concat(state["parts"], more)).otherwise(state["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    replaced = F.aggregate(
        held,
        start,
        replace,
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    changed = F.size(held) > 0
    out = marked.withColumn(new, F.when(changed, replaced).otherwise(text))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col(new).alias("text"))
        elif name == "n_chars":
            columns.append(F.when(changed, F.char_length(new)).otherwise(docs[name]).cast("bigint").alias(name))
        else:
            columns.append(docs[f"`{name}`"])
    return out.select(*columns)
