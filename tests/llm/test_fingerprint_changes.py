"""Fingerprints under insertion and deletion, and of texts with very many paragraphs."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from martlens.llm import fingerprints


def printed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", fingerprints.paragraphs(F.col("text")).alias("ps"))
    rows = fingerprints.paragraph_sums(docs, ["i"], "ps").select("i", fingerprints.fingerprint().alias("f")).orderBy("i")
    return [r["f"] for r in rows.collect()]


def test_insertion_and_deletion(spark):
    rng = random.Random(7)
    lines = [f"line {rng.randrange(50)}" for _ in range(40)]
    whole, some, rest = printed(spark, ["\n".join(lines), "\n".join(lines[:15]), "\n".join(reversed(lines[15:]))])
    row = spark.createDataFrame([(whole, some, rest, None)], "w string, s string, r string, n string")
    added, taken, none = row.select(fingerprints.combined(F.col("s"), F.col("r")), fingerprints.combined(F.col("w"), F.col("s"), -1), fingerprints.combined(F.col("w"), F.col("n"))).first()
    assert added == whole and taken == rest and none is None


def test_more_paragraphs_than_twenty_bits(spark):
    """Every lane is its own sum: none carries into the one beside it."""
    n = (1 << 20) + 5
    (found,) = printed(spark, ["x\n" * n])
    md5, sha = hashlib.md5(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest()
    halves = [int(md5[:15], 16), int(md5[15:30], 16)]
    want = f"{n:08x}" + "".join(f"{int(sha[8 * i : 8 * i + 8], 16) * n % (1 << 32):08x}" for i in range(8))
    for i in range(60):
        bits = halves[i // 30] >> (i % 30)
        want += f"{(bits & 1) * n | (bits >> 30 & 1) * n << 30:015x}"
    assert found == want
