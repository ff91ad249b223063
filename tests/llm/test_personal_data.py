"""Candidates of bank accounts and national phone numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pdwatch.llm import pii

ACCOUNTS = [
    "DE89 3704 0044 0532 0130 00",
    "GB29 NWBK 6016 1331 9268 19",
    "FR14 2004 1010 0505 0001 3M02 606",
    "NL91 ABNA 0417 1643 00",
    "IT60 X054 2811 1010 0000 0123 456",
    "ES91 2100 0418 4502 0005 1332",
    "NO93 8601 1117 947",
    "MU17 BOMM 0101 1010 3030 0200 000M UR",
]
PHONES = [
    "(555) 123-4567",
    "555-123-4567",
    "01 23 45 67 89",
    "01.23.45.67.89",
    "0123456789",
    "612 345 678",
    "612345678",
    "912 34 56 78",
    "91 234 56 78",
    "030 1234567",
    "(030) 1234567",
    "0171/1234567",
    "030 / 1234567",
    "0171 123 45 67",
    "0221 12 34 56",
    "020 7946 0958",
    "07700 900123",
    "0161 496 0000",
    "01711234567",
]
WRONG = ["DE89", "AB12 CDEF", "DE89 3704 0044", "01-02-2003", "012/345", "2003", "1 000 000", "5123456789", "ISO 9001 2015"]


def _candidates(spark, texts):
    rows = spark.createDataFrame([(text,) for text in texts], "text string")
    found = rows.select(pii._looser(F.col("text"), pii.base_spans(F.col("text"))).alias("c")).collect()
    return [[(c["start"], c["value"]) for c in row["c"]] for row in found]


@pytest.mark.parametrize("frame", ["{}", "see {}, then", "see {} OK 4.", "see {}\nMORE"])
def test_accounts_and_phones_are_whole_candidates(spark, frame):
    values = [*ACCOUNTS, *(account.replace(" ", "") for account in ACCOUNTS), *PHONES]
    found = _candidates(spark, [frame.format(value) for value in values])
    assert found == [[(frame.index("{"), value)] for value in values]


def test_other_numbers_are_no_candidates(spark):
    assert _candidates(spark, [f"see {text}." for text in WRONG]) == [[] for _ in WRONG]


def test_accounts_are_masked_whole(spark):
    base = [f"mail a{n}@b.org, call +1 555 123 {4000 + n}" for n in range(40)]
    others = [f"version 123-45-{4000 + n}" for n in range(20)]
    values = [*ACCOUNTS[:6], *(account.replace(" ", "") for account in ACCOUNTS[:6])]
    texts = [*base, *others, *(f"my account {v}." for v in values)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    masked = [row["text"] for row in pii.mask(docs).orderBy("doc_id").collect()][60:]
    assert masked == ["my account <OTHER>."] * len(values)
