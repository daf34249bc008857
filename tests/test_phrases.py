"""Sentiment of negated and strengthened phrases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from martlens.functions import text

CASES = [
    ("good", 0.5, 0.6, 1, 0),
    ("not good", -0.25, 0.6, 1, 1),
    ("very good", 0.65, 0.78, 1, 0),
    ("not very good", -0.325, 0.78, 1, 1),
    ("very, very good", 0.845, 1.0, 1, 0),
    ("very excellent", 1.0, 1.0, 1, 0),
    ("slightly bad", -0.25, 0.3, 1, 0),
    ("not at all this good", 0.5, 0.6, 1, 0),  # four words on
    ("not at all good", -0.25, 0.6, 1, 1),
    ("It is not. Good!", 0.5, 0.6, 1, 0),
    ("not good but bad", -0.375, 0.6, 2, 1),  # the first opinion uses up the negation
    ("really a good one", 0.5, 0.6, 1, 0),  # a word lies between
    ("It isn’t GOOD", -0.25, 0.6, 1, 1),
    ("ce n'est pas très bon", -0.325, 0.78, 1, 1),
    ("nothing to say", 0.0, 0.0, 0, 0),
    ("", 0.0, 0.0, 0, 0),
    (None, 0.0, 0.0, 0, 0),
    ("not " * 50_000 + "good", -0.25, 0.6, 1, 1),
]


def test_phrases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", text.phrase_sentiment(F.col("t")).alias("x")).select("i", "x.*").collect()}
    for i, (said, polarity, subjectivity, n, negated) in enumerate(CASES):
        r = got[i]
        assert (r["sentiment_polarity"], r["sentiment_subjectivity"], r["opinions"], r["negated"]) == (pytest.approx(polarity), pytest.approx(subjectivity), n, negated), (said or "")[:40]
