"""Exact duplicates by distributed MSD radix partitioning: equality is decided by the bytes themselves, without digests.

Texts are split by their leading bytes, then every group by the bytes that follow, and so on until a group has one text
or its texts have ended; texts that end together in one group are equal. Each round looks at a slice of bytes, eight
times as wide as the one before, so the number of rounds grows with the logarithm of the longest text. A round counts
the members of (group, slice) with partial sums in every task, so a group of very many copies is one row for each task,
and carries the counts back to the rows; the table of counts is written first, so that Spark can deal the rows of a
frequent slice to several tasks. Only rows of groups that go on take the rest of their bytes into the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WrittenTables, cut

#: Bytes of the first slice, growth from round to round, and the widest slice.
FIRST_BYTES, GROWTH, MOST_BYTES = 64, 8, 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; its length in bytes stays."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def exact_duplicates(docs: DataFrame, first: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest doc_id stays and gives keep_id; a null id counts as smaller than others, so keep_id is null only where all
    ids of a group are. Of rows that repeat id and text one stays. text_sha256 is put out only: nothing is decided by it.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["grp", "slice", "more"]
    settled = ["doc_id", "keep_id", "n", "kept", "sha"]
    with WrittenTables(spark) as tables:
        # the first slice only parts what is alone from what is not: rows get their names when they are written
        head = lowered(F.substring("text", 1, first)).cast("binary")
        place = [F.lit(0).cast("long").alias("grp"), F.substring(head, 1, first).alias("slice"), (F.octet_length("text") > first).alias("more")]
        shared = texts.select(*place).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        shared = tables.write(shared.select(*keys, F.monotonically_increasing_id().alias("gid")), "shared_0")
        body = lowered(F.col("text")).cast("binary")
        rows = texts.select(*place, "doc_id", F.sha2(body, 256).alias("sha"), body.alias("rest")).join(shared.hint("merge"), keys, "left")
        alone = F.col("gid").isNull()
        rows = rows.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha",
            F.monotonically_increasing_id().alias("key"), F.col("gid").alias("grp"), F.when(~alone, F.expr(f"substring(rest, {first + 1})")).alias("rest"), alone.cast("int").alias("done"),
        )
        rounds = [tables.write(rows, "rows_0", by="done")]
        tables.drop("shared_0")
        width = first
        while not (rows := rounds[-1].where("done = 0")).isEmpty():
            i, width = len(rounds), min(width * growth, MOST_BYTES)
            rows = rows.select("grp", F.expr(f"substring(rest, 1, {width})").alias("slice"), (F.octet_length("rest") > width).alias("more"), "doc_id", "sha", "key", "rest")
            found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("key", "doc_id"), F.min("key")).alias("keep_key"), F.min("key").alias("gid")).where("n > 1")
            shared = tables.write(found, f"shared_{i}")
            rows = rows.join(shared.hint("merge"), keys, "left")
            alone = F.col("n").isNull()
            open_ = ~alone & F.col("more")
            rows = rows.select(
                "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), (alone | (F.col("key") == F.col("keep_key"))).alias("kept"), "sha",
                "key", F.col("gid").alias("grp"), F.when(open_, F.expr(f"substring(rest, {width + 1})")).alias("rest"), (~open_).cast("int").alias("done"),
            )
            rounds.append(tables.write(rows, f"rows_{i}", by="done"))
            tables.drop(f"rows_{i - 1}/done=0")
            tables.drop(f"shared_{i}")
        out = rounds[0].where("done = 1").select(*settled)
        for part in rounds[1:]:
            out = out.unionByName(part.where("done = 1").select(*settled))
        out = cut(out)
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def exact_duplicates_sql(documents: str) -> str:
    """DuckDB SQL for exact_duplicates over a table with distinct ids."""
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM {documents})
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256 FROM texts WINDOW same AS (PARTITION BY t)
"""
