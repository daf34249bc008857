"""Exchange rates as of a time, with a limit to their age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rates_as_of(amounts: DataFrame, quotes: DataFrame, valid_seconds: int = 86_400, piece_seconds: int = 3600) -> DataFrame:
    """amounts (currency, ts, ...) with ``rate`` and ``quoted_at``: the last quote of the currency at or before ts that is less
    than ``valid_seconds`` old; null where there is none.

    quotes has (currency, ts, rate); of quotes at one time the least counts. Amounts meet the quotes of their own piece of
    time, and of earlier ones only the last, so no currency is sorted as a whole.
    """
    piece = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (piece_seconds * 1_000_000)).cast("long")
    named = {c: f"_{c}" for c in amounts.columns if c not in ("currency", "ts")}
    one = quotes.where("currency is not null and ts is not null and rate is not null").groupBy("currency", "ts").agg(F.min("rate").alias("quote")).withColumn("piece", piece)
    rows = amounts.withColumnsRenamed(named).withColumn("piece", piece)
    both = rows.withColumn("q", F.lit(None).cast(one.select(F.struct("ts", "quote")).schema[0].dataType)).unionByName(one.select("currency", "ts", "piece", F.struct("ts", "quote").alias("q"), F.lit(True).alias("_quote")), allowMissingColumns=True)
    # quotes come before amounts of the same time; rows without currency or ts are spread, for they meet nothing
    lone = F.when(F.col("currency").isNull() | F.col("ts").isNull(), F.monotonically_increasing_id())
    here = Window.partitionBy("currency", "piece", "_lone").orderBy("ts", F.col("_quote").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_lone", lone).withColumn("q", F.last("q", ignorenulls=True).over(here)).where("_quote is null").drop("_quote", "_lone")
    pieces = rows.select("currency", "piece").distinct().join(one.groupBy("currency", "piece").agg(F.max(F.struct("ts", "quote")).alias("end")), ["currency", "piece"], "full")
    before = Window.partitionBy("currency").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece
    carried = pieces.withColumn("carry", F.last("end", ignorenulls=True).over(before)).select("currency", "piece", "carry")
    found = met.join(carried, ["currency", "piece"], "left").withColumn("q", F.coalesce("q", "carry"))
    fresh = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("q.ts").cast("timestamp")) < valid_seconds * 1_000_000
    return found.select(*[F.col(named.get(c, c)).alias(c) for c in amounts.columns], F.when(fresh, F.col("q.quote")).alias("rate"), F.when(fresh, F.col("q.ts")).alias("quoted_at"))
