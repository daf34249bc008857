"""Ranks and exact quantiles without sorting a group in one task: values are cut into ranges whose totals are added up."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values, at least; there are four for each shuffle partition.
RANGES = 1024


def range_marks(df: DataFrame, value: str, ranges: int | None = None) -> list:
    """Ascending values that cut a numeric column into ranges of about equal numbers of rows."""
    ranges = ranges or max(RANGES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.select(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    return sorted(set(found))


def range_of(value: Column, marks: Sequence) -> Column:
    """How many marks are less than the value, found in two steps of the root of their number."""
    if not marks:
        return F.lit(0)
    step = math.isqrt(len(marks) - 1) + 1
    every, coarse = (F.array(*[F.lit(m) for m in ms]) if ms else None for ms in (marks, marks[step - 1 :: step]))
    whole = F.size(F.filter(coarse, lambda m: m < value)) * step if coarse is not None else F.lit(0)
    return whole + F.size(F.filter(F.slice(every, whole + 1, F.lit(step)), lambda m: m < value))


def beside(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    other = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(other[f"_k{i}"])
    return rows.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])


def running(counts: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Rows (by..., value, sums...), values distinct within a group, with before_<sum>: the totals of the values before theirs."""
    rows = counts.withColumn("_r", range_of(F.col(value), range_marks(counts, value)))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    zero = F.lit(0).cast("long")
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(way("_r")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = rows.groupBy(*by, "_r").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(*by, "_r", *[F.coalesce(F.sum(f"_t_{s}").over(over), zero).alias(f"_t_{s}") for s in sums])
    within = Window.partitionBy(*by, "_r").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_w_{s}": F.coalesce(F.sum(s).over(within), zero) for s in sums})
    rows = beside(rows, totals, [*by, "_r"])
    return rows.select(*counts.columns, *[(F.col(f"_w_{s}") + F.col(f"_t_{s}")).alias(f"before_{s}") for s in sums])


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q0, q1, ...): exact quantiles of each group's non-null values, interpolated between neighbours.

    A group without values has no row, and without groups such a table gives one row of nulls.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    rows = running(counts, "_v", ["n"], by)
    rows = beside(rows, sizes, by) if by else rows.crossJoin(F.broadcast(sizes))  # one row
    aggregates = []
    for i, share in enumerate(shares):
        at = (F.col("_all") - 1) * F.lit(float(share))
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggregates.append(F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col("_v"))).alias(f"{name}{i}"))
        aggregates.append(F.max(at - F.floor(at)).alias(f"part{i}"))
    out = rows.groupBy(*by).agg(*aggregates)
    return out.select(*by, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(shares))])


def with_quantiles(aggregates: DataFrame, found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each group: aggregates and quantiles of the same table."""
    if not by:
        return aggregates.crossJoin(F.broadcast(found))  # one row each
    other = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in found.columns if c not in by])
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & aggregates[k].eqNullSafe(other[f"_k{i}"])
    return aggregates.join(other, on, "left").drop(*[f"_k{i}" for i in range(len(by))])
