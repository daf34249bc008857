"""Fingerprints where ids repeat or lack: the same rows as SQL, and no task with all rows of one id."""

from __future__ import annotations

import random

import duckdb
import pandas as pd

from martlens.llm import common, fingerprints
from tests.oracle import spark_rows, sql_rows


def both(spark, rows):
    pdf = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": pd.Series([r[1] for r in rows], dtype=object)})
    con = duckdb.connect()
    con.register("documents", pdf)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    return docs, spark_rows(fingerprints.edited_fingerprints(docs, parts=5)), sql_rows(con, fingerprints.edited_fingerprints_sql("documents"))


def test_repeated_and_missing_ids_equal_sql(spark):
    rng = random.Random(5)
    say = lambda: ". ".join(rng.choice(["one", "two three", "four", "é", "five six"]) for _ in range(rng.randrange(6)))
    rows = [(rng.choice([None, 3, 3, rng.randrange(40)]), rng.choice([None, "", "same text. again", say()])) for _ in range(300)]
    _, got, want = both(spark, rows)
    assert got == want and len(got[1]) == len(rows)


def test_equal_rows_first_and_last(spark):
    """Copies before the last are followed by themselves; the last of all rows by the first."""
    for rows in ([(4, "a. b")] * 3, [(None, None)] * 2, [(9, "x y")] * 2 + [(None, "tail. end")] * 3):
        _, got, want = both(spark, rows)
        assert got == want


def test_more_copies_than_a_chunk(spark):
    rows = [(None, None)] * (2 * common.CHUNK + 7) + [(1, "a. b")]
    found = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=5)
    assert {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()} == {None: 2 * common.CHUNK + 7, 1: 1}


def test_a_third_of_all_rows_without_id_is_spread(spark):
    docs = spark.range(30_000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "concat(sha2(CAST(id % 20000 AS STRING), 256), '. end') AS text")
    sizes = [r["count"] for r in fingerprints.ranged(docs, 30).groupBy("bucket").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 3 * 30_000 / 30
