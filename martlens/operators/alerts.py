"""What a monitoring system computes from samples: alerts that hold for a time, counter rates, and quantiles of histograms.

Samples of one name are never sorted in one task: they are worked on in pieces of time, and pieces are put together from
one row each, so a name with a third of all samples costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _piece(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def sustained_alerts(samples: DataFrame, hold_seconds: int, piece_seconds: int = 86_400) -> DataFrame:
    """(name, since, fired_at, last_at, samples) of each alert: a run of samples of a name that hold, one after the other,
    for at least ``hold_seconds``.

    samples has (name, ts, holds). since is the run's first sample, fired_at its first one at least ``hold_seconds`` later,
    last_at its last; a sample that does not hold, or is null, ends a run, and of samples at one time one that does not hold
    counts. Runs go on over the borders of pieces: of each piece only the run that is open at its end is passed on. Rows
    without ts are no samples.
    """
    one = samples.where("ts is not null").groupBy("name", "ts").agg(F.min(F.coalesce("holds", F.lit(False))).alias("holds"), F.count("*").alias("n"))
    here = Window.partitionBy("name", "piece").orderBy("ts")
    broken = F.max(F.when(~F.col("holds"), F.col("ts"))).over(here)
    rows = one.withColumn("piece", _piece("ts", piece_seconds)).withColumn("broken", broken)
    start = F.min(F.when(F.col("holds"), F.col("ts"))).over(Window.partitionBy("name", "piece", "broken"))
    rows = rows.withColumn("start", start)
    pieces = rows.groupBy("name", "piece").agg(F.min("ts").alias("first"), F.max_by("holds", "ts").alias("open"), F.max_by("start", "ts").alias("tail"), F.max("broken").alias("broken"))
    along = Window.partitionBy("name").orderBy("piece")  # one row for each piece of time
    # the run open before a piece began in the last piece that was broken, or else in the first one after it
    tail = F.when(F.col("open"), F.struct(F.when(F.col("broken").isNotNull(), F.col("tail")).alias("at"), F.lit(True).alias("open"))).otherwise(F.struct(F.lit(None).cast(rows.schema["ts"].dataType).alias("at"), F.lit(False).alias("open")))
    fresh = F.col("broken").isNotNull() | F.lag("open").over(along).isNull() | ~F.lag("open").over(along)
    begins = F.when(F.col("broken").isNotNull(), tail).when(fresh, F.struct(F.col("first").alias("at"), F.lit(True).alias("open")))
    before = Window.partitionBy("name").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("name", "piece", begins.alias("begins")).withColumn("carry", F.last("begins", ignorenulls=True).over(before)).select("name", "piece", F.when(F.col("carry.open"), F.col("carry.at")).alias("carry"))
    since = F.when(F.col("broken").isNull(), F.coalesce("carry", "start")).otherwise(F.col("start"))
    runs = rows.where("holds").join(carried, ["name", "piece"]).withColumn("since", since)
    long_enough = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= hold_seconds * 1_000_000
    found = runs.groupBy("name", "since").agg(F.min(F.when(long_enough, F.col("ts"))).alias("fired_at"), F.max("ts").alias("last_at"), F.sum("n").alias("samples"))
    return found.where("fired_at is not null")


def _increase(now: Column, before: Column) -> Column:
    """By how much a counter went up from one sample to the next; a counter that went down was reset and began at 0."""
    return F.when(now < before, now).otherwise(now - before)


def counter_rates(samples: DataFrame, range_seconds: int, step_seconds: int) -> DataFrame:
    """(name, at, increase, rate) at the end of each step that has samples: the increase of a counter over the range before.

    samples has (name, ts, value). The increase adds up what lies between consecutive samples of the range, resets apart;
    the rate is that for each second of the range, which must be a multiple of the step. A step's samples become one row:
    first and last value and the increase between them. Rows of two steps merge by the increase from the last to the
    first, so a range is a sum over at most range / step rows. Of samples at one time the greatest counts; rows without ts
    or value are no samples.
    """
    one = samples.where("ts is not null and value is not null").groupBy("name", "ts").agg(F.max("value").alias("value"))
    here = Window.partitionBy("name", "step").orderBy("ts")
    rows = one.withColumn("step", _piece("ts", step_seconds)).withColumn("up", _increase(F.col("value"), F.lag("value").over(here)))
    steps = rows.groupBy("name", "step").agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"), F.coalesce(F.sum("up"), F.lit(0)).alias("inner"))
    along = Window.partitionBy("name").orderBy("step")  # one row for each step
    steps = steps.withColumn("cross", F.coalesce(_increase(F.col("first"), F.lag("last").over(along)), F.lit(0)))
    last = Window.partitionBy("name").orderBy("step").rangeBetween(1 - range_seconds // step_seconds, 0)
    total = F.sum("inner").over(last) + F.sum("cross").over(last) - F.first("cross").over(last)
    at = F.timestamp_seconds((F.col("step") + 1) * step_seconds)
    return steps.select("name", at.alias("at"), total.cast("double").alias("increase")).withColumn("rate", F.col("increase") / range_seconds)


def histograms(samples: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """(keys..., le_0, le_1, ..., total): cumulative counts of values up to each bound, and of all; nulls are no values."""
    return samples.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)], F.count(value).alias("total"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms of the same bounds, added up by fewer keys."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c.startswith("le_") or c == "total"])


def bucket_quantile(q: float, bounds: Sequence[float]) -> Column:
    """The q-quantile of a row of ``histograms``, linear within the bucket that holds it.

    The first bucket begins at 0, or at its bound if that is not positive; beyond the last bound there is nothing to go by,
    so the quantile is that bound. Null for a histogram without values.
    """
    rank, out = F.lit(float(q)) * F.col("total"), F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        low, below = (bounds[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.lit(float(low)) + F.lit(float(bounds[i] - low)) * (rank - below) / (F.col(f"le_{i}") - below)
        inside = F.when(F.col(f"le_{i}") > below, inside).otherwise(float(bounds[i])) if i or bounds[0] > 0 else F.lit(float(bounds[0]))
        out = F.when(F.col(f"le_{i}") >= rank, inside).otherwise(out)
    return F.when(F.col("total") > 0, out)
