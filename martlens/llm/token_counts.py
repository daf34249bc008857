"""Exact length histogram of documents in tokens, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import encode_slices


def _lengths(path: str, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for _, _, _, edges in encode_slices(batch.column("text"), path, added):
                for length, n in zip(*np.unique(np.diff(edges), return_counts=True), strict=True):
                    counts[int(length)] = counts.get(int(length), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["length", "docs"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """(length, docs): how many documents have that many tokens. A null or empty text has 0; every row counts.

    With ``added`` the tokenizer's added tokens count as one token each, else they are ordinary text.
    """
    return docs.select("text").mapInArrow(_lengths(tokenizer, added), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def context_totals(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """The histogram with, for each length L taken as context limit:

    docs_longer, tokens_longer: documents over L, and their tokens; docs_fit: documents that fit whole;
    tokens_kept: tokens if each document is cut to L; tokens_cut: those lost; rank_from, rank_to: the 1-based ranks of
    these documents by length, from which every quantile follows.

    Suffix sums run within blocks of lengths and over block totals, so no task gets all lengths. The histogram, one row for
    each length, is written out first: three aggregates read it, and its texts are encoded once. An empty one gives no rows.
    """
    histogram = cut(histogram)
    rows = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("docs"))
    over = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(over), zero).alias("block_docs"), F.coalesce(F.sum("t").over(over), zero).alias("block_tokens"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = histogram.agg(F.sum("docs").alias("all_docs"), F.sum(F.col("docs") * F.col("length")).alias("all_tokens"))
    return (
        rows.withColumn("d", F.coalesce(F.sum("docs").over(within), zero))
        .withColumn("t", F.coalesce(F.sum("tokens").over(within), zero))
        .join(blocks, "block")
        .join(F.broadcast(total))  # one row
        .select(
            "length",
            "docs",
            (F.col("d") + F.col("block_docs")).alias("docs_longer"),
            (F.col("t") + F.col("block_tokens")).alias("tokens_longer"),
            "all_docs",
            "all_tokens",
        )
        .select(
            "length",
            "docs",
            "docs_longer",
            "tokens_longer",
            (F.col("all_docs") - F.col("docs_longer")).alias("docs_fit"),
            (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("tokens_kept"),
            (F.col("tokens_longer") - F.col("docs_longer") * F.col("length")).alias("tokens_cut"),
            (F.col("all_docs") - F.col("docs_longer") - F.col("docs") + 1).alias("rank_from"),
            (F.col("all_docs") - F.col("docs_longer")).alias("rank_to"),
        )
    )


def quantile_length(totals: DataFrame, share: float) -> DataFrame:
    """(length): the least length that at least this share of the documents does not exceed."""
    last = totals.agg(F.max("rank_to").alias("n"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    return totals.join(F.broadcast(last)).where((F.col("rank_from") <= need) & (need <= F.col("rank_to"))).select("length")
