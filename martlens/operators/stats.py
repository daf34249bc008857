"""Descriptive statistics as small DataFrames with total orders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles, with_quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) of non-null values."""
    return counts_by(df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")), ["value"])


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns..., n, pct): rows of each combination and their share of all rows, added up from the counts: a single row beside."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(*columns, "n", F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("pct"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).orderBy(F.col("n").desc(), "value").limit(n)


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max."""
    out = df.groupBy(*by).agg(F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.round(F.stddev_samp(column), 4).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    out = with_quantiles(out, quantiles(df, column, (0.25, 0.5, 0.75), by), by)
    return out.select(*by, "n", "mean", "std", "min", *[F.round(f"q{i}", 4).alias(a) for i, a in enumerate(("q1", "median", "q3"))], "max")


def summarize(df: DataFrame, column: str, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """(by..., n, mean, med, lo, hi, std) of a column, the median exact."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(column), digits).alias("mean"), F.round(F.min(column), digits).alias("lo"), F.round(F.max(column), digits).alias("hi"), F.round(F.stddev_samp(column), digits).alias("std"))
    return with_quantiles(out, quantiles(df, column, (0.5,), by), by).select(*by, "n", "mean", F.round("q0", digits).alias("med"), "lo", "hi", "std")


def box_plot(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by..., q1, median, q3, low, high, outliers): quartiles, whiskers at the last values within 1.5 interquartile ranges,
    and how many values lie beyond them."""
    q = quantiles(df, column, (0.25, 0.5, 0.75), by).withColumn("_w", (F.col("q2") - F.col("q0")) * 1.5)
    rows = with_quantiles(df.where(F.col(column).isNotNull()).select(*by, column), q, by)
    inside = F.col(column).between(F.col("q0") - F.col("_w"), F.col("q2") + F.col("_w"))
    return rows.groupBy(*by).agg(*[F.round(F.max(f"q{i}"), 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"), F.count_if(~inside).alias("outliers"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal widths from minimum to maximum, the last bin closed; the range is one row."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.least(F.floor((F.col(column) - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))) + 1, F.lit(bins))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column_name, missing, pct) of every column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in df.columns])).alias("x")).select("x.*", F.round(F.try_divide(F.col("x.missing") * 100.0, F.col("_n")), 4).alias("pct"))


def missing_only(df: DataFrame) -> DataFrame:
    """missing_by_column of the columns that miss something."""
    return missing_by_column(df).where(F.col("missing") > 0)


def pearson(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, correlation) of columns with a target; null for a column or target without variance."""
    corr = lambda c: F.try_divide(F.covar_pop(c, target), F.stddev_pop(c) * F.stddev_pop(F.when(F.col(c).isNotNull(), F.col(target))))
    one = df.agg(*[F.round(corr(c), 6).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])).alias("x")).select("x.*")


def _pooled(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """(ma, mb, t, freedom), one row: means of either group, the pooled t statistic as it is, na + nb - 2."""
    pick = lambda f, c: f(F.when(c, F.col(value)))
    one = df.agg(*[f.alias(n) for n, f in {"na": pick(F.count, flag), "nb": pick(F.count, ~flag), "ma": pick(F.avg, flag), "mb": pick(F.avg, ~flag), "va": pick(F.var_samp, flag), "vb": pick(F.var_samp, ~flag)}.items()])
    spread = "sqrt(try_divide((na - 1) * va + (nb - 1) * vb, na + nb - 2) * (try_divide(1D, na) + try_divide(1D, nb)))"
    return one.selectExpr("ma", "mb", f"try_divide(ma - mb, {spread}) as t", "na + nb - 2 as freedom")


def pooled_t(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """(mean_a, mean_b, t): two-sample t statistic with pooled variance; t is null if a group is empty or nothing varies."""
    return _pooled(df, value, flag).selectExpr("round(ma, 4) as mean_a", "round(mb, 4) as mean_b", "round(t, 4) as t")


#: Steps of the integrals behind a p value, and the deviations that they go out to.
P_STEPS, P_REACH = 2000, 12


def p_value_sql(steps: str) -> str:
    """SQL, in Spark and DuckDB, for the two-sided p value of columns t and freedom: with x = sqrt(freedom) tan(angle), the density
    of t is a power of the cosine, so p is the share of its integral beyond the angle of t, both by Simpson's rule. ``steps``
    says how to sum an expression in k from 0 to P_STEPS."""
    high = f"least(pi() / 2, {P_REACH} / sqrt(CAST(freedom AS DOUBLE)))"
    low = f"least(atan(abs(t) / sqrt(CAST(freedom AS DOUBLE))), {high})"
    term = lambda at: f"(CASE WHEN k = 0 OR k = {P_STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(greatest(CAST(0 AS DOUBLE), cos({at} + ({high} - {at}) * k / {P_STEPS})), CAST(freedom - 1 AS DOUBLE))"
    return f"CASE WHEN freedom > 0 AND t IS NOT NULL THEN round({steps.format(term(low))} * ({high} - {low}) / ({steps.format(term('0'))} * {high}), 6) END"


def two_sided_p(t: float, freedom: float) -> float:
    """The chance of a t statistic at least that far from 0: the regularized incomplete beta function, by its continued fraction."""
    import math

    if not math.isfinite(t) or freedom <= 0:
        return float("nan")
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300))) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    whole = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            whole *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * whole if swap else front * whole


def t_test(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """pooled_t with freedom and the two-sided p value of its one row, from t as it is; no action while the plan is built."""
    summed = f"aggregate(sequence(0, {P_STEPS}), 0D, (s, k) -> s + {{}})"
    return _pooled(df, value, flag).selectExpr("round(ma, 4) as mean_a", "round(mb, 4) as mean_b", "round(t, 4) as t", "freedom", f"{p_value_sql(summed)} as p_value")


#: Left texts of one task's group, right texts that a group meets at a time, and pairs that are counted at once.
LEFT_TEXTS, RIGHT_TEXTS, PAIRS_AT_ONCE = 2048, 1024, 1 << 22


def token_overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float) -> DataFrame:
    """(left_key, right_key, similarity): pairs of texts whose sets of words have a Jaccard similarity of at least ``least``.

    Groups of left texts meet groups of right texts, both of bounded size, and the common words of all pairs of a group are
    counted through lists of the right texts that hold a word. So no pair is written before it is known to be similar, no
    word gathers the texts that hold it, and each left text is shuffled once for each group of right texts. Texts that
    have too many words to be like the largest of the other side do not get there. Repeated and missing keys are kept.
    """
    words = lambda df, key: df.select(F.col(key).alias("key"), F.array_distinct(F.array_remove(F.split(F.lower("text"), r"\s+"), "")).alias("words")).where(F.size("words") > 0)
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((left, LEFT_TEXTS), (right, RIGHT_TEXTS)))
    dealt = lambda n, other: [F.pmod(F.xxhash64("key", "words"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))]
    part, block = dealt(parts, blocks)
    most = words(right, right_key).agg((F.max(F.size("words")) / F.lit(least)).alias("most"))
    x = words(left, left_key).crossJoin(F.broadcast(most)).where(F.size("words") <= F.col("most") + 1).select(part.alias("part"), block.alias("block"), "key", "words")  # one row
    block, part = dealt(blocks, parts)
    y = words(right, right_key).select(block.alias("block"), part.alias("part"), "key", "words")
    kinds = [df.schema[k].dataType.simpleString() for df, k in ((left, left_key), (right, right_key))]
    return x.groupBy("part", "block").cogroup(y.groupBy("part", "block")).applyInArrow(_similar(left_key, right_key, least), f"`{left_key}` {kinds[0]}, `{right_key}` {kinds[1]}, similarity double").withColumn("similarity", F.round("similarity", 6))


def _similar(left_key: str, right_key: str, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (t.combine_chunks().column("words").combine_chunks() for t in (left, right))
        at, to, shares = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(x) and len(y):
            a, b = (pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in (x, y))
            known = pc.unique(y.flatten())
            word, item = pc.index_in(y.flatten(), known).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(y)), b)
            lists = item[np.argsort(word, kind="stable")]  # right texts, word by word
            held = np.bincount(word, minlength=len(known))
            first = np.cumsum(held) - held
            found, owner = pc.index_in(x.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(x)), a)
            found, owner = found[found >= 0], owner[found >= 0]
            met = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=held[found], minlength=len(x)).astype(np.int64))])
            begin = 0
            while begin < len(x):
                # as many left texts as fit, at least one
                end = max(begin + 1, min(int(np.searchsorted(met, met[begin] + PAIRS_AT_ONCE, "right")) - 1, begin + PAIRS_AT_ONCE // len(y)))
                i, j = np.searchsorted(owner, [begin, end])
                n = held[found[i:j]]
                places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[found[i:j]], n)
                common = np.bincount(np.repeat(owner[i:j] - begin, n) * len(y) + lists[places], minlength=(end - begin) * len(y)).reshape(end - begin, len(y))
                share = common / (a[begin:end, None] + b[None, :] - common)
                u, v = np.nonzero((common > 0) & (share >= least))
                at, to, shares = [*at, u + begin], [*to, v], [*shares, share[u, v]]
                begin = end
        pick = lambda t, rows: t.column("key").take(pa.array(np.concatenate(rows)))
        return pa.table({left_key: pick(left, at), right_key: pick(right, to), "similarity": pa.array(np.concatenate(shares), pa.float64())})

    return run

