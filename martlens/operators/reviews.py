"""Review scoring: splits, scaling, ensembles and model metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ENSEMBLE, FAKE_CODE
from .ranks import running


def _ranked(df: DataFrame, key: str, label: str) -> DataFrame:
    """With _rank, the 1-based place by MD5 of the key among the rows of a label, and _all, their number; bucketed, so no label is sorted whole."""
    rows = df.withColumn("_h", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    sums = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(w))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    return rows.join(sums.drop("_n"), [label, "_b"]).withColumn("_rank", rank).drop("_h", "_b", "_before")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8) -> DataFrame:
    """With ``part``: train for the share of each label's rows whose keys have the smallest MD5."""
    rows = _ranked(df, key, label)
    return rows.withColumn("part", F.when(F.col("_rank") <= F.floor(F.col("_all") * share), "train").otherwise("test")).drop("_rank", "_all")


def sized_split(df: DataFrame, key: str, label: str, share: float = 0.2) -> DataFrame:
    """With ``part``, by the rules of small tables: under ten rows all are train and the first two by key are test as well,
    in rows of their own; else the test part has ``min(max(1, floor(n * share)), n - 2)`` rows, spread over the labels by
    largest remainders. Rows without a label are left out."""
    df = df.where(F.col(label).isNotNull())
    n = df.count()
    if n < 10:
        return df.withColumn("part", F.lit("train")).unionByName(df.orderBy(key).limit(2).withColumn("part", F.lit("test")))
    size = min(max(1, int(n * share)), n - 2)
    sizes = df.groupBy(label).agg(F.count("*").alias("_m"))  # one row for each label
    exact = F.col("_m") * F.lit(size) / F.lit(n)
    sizes = sizes.select(F.col(label).alias("_l"), F.floor(exact).alias("_q"), (exact - F.floor(exact)).alias("_f"))
    short = F.lit(size) - F.sum("_q").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_f").desc(), "_l"))
    sizes = sizes.select("_l", (F.col("_q") + (place <= short).cast("long")).alias("_q"))
    rows = _ranked(df, key, label)
    rows = rows.join(F.broadcast(sizes), rows[label] == sizes["_l"]).drop("_l")
    return rows.withColumn("part", F.when(F.col("_rank") <= F.col("_q"), "test").otherwise("train")).drop("_rank", "_all", "_q")


def class_balance(split: DataFrame, label: str) -> DataFrame:
    """(part, n, share): rows of each part and the mean of their labels."""
    return split.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(label), 6).alias("share"))


def summary(reviews: DataFrame, label: str, rating: str, length: Column) -> DataFrame:
    """One row: reviews, fakes and their share, mean and deviation of the rating, mean length."""
    return reviews.agg(F.count("*").alias("reviews"), F.sum(label).alias("fakes"), F.round(F.avg(label) * 100, 4).alias("fake_pct"), F.round(F.avg(rating), 4).alias("rating_mean"), F.round(F.stddev_samp(rating), 4).alias("rating_std"), F.round(F.avg(length), 4).alias("length_mean"))


def fake_share(scored: DataFrame, flag: str) -> DataFrame:
    """(flag, n, pct) of predicted fakes and others."""
    from .stats import counts_by

    return counts_by(scored, [flag])


def score_table(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(score, mean, median, std) of each model's scores, the median exact."""
    from .stats import summarize

    out = None
    for c in columns:
        one = summarize(scored, c, digits=4).select(F.lit(c).alias("score"), "mean", F.col("med").alias("median"), "std")
        out = one if out is None else out.unionByName(one)
    return out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, those whose keys hash lowest under the seed; their number is the feature."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """With ``<column>_index``: the position among the sorted distinct values; these are numbered by their first letters."""
    values = df.select(F.col(column).alias("_v")).where(F.col(column).isNotNull()).distinct().withColumn("_p", F.substring(F.col("_v").cast("string"), 1, 2))
    heads = values.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each pair of first letters
    heads = heads.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_v")) - 1
    index = values.withColumn("_i", rank).join(heads, "_p").select(F.col("_v").alias(column), (F.col("_first") + F.col("_i")).cast("long").alias(f"{column}_index"))
    return df.join(index, column, "left")


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus mean over population deviation; constant columns become 0; the statistics are one row."""
    one = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = df.crossJoin(F.broadcast(one))
    return scaled.withColumns({c: F.coalesce(F.round((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), 4), F.lit(0.0)) for c in columns}).drop(*one.columns)


def scaled_by(df: DataFrame, fitted_on: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of df minus the mean over the population deviation that ``fitted_on`` has, so nothing of test rows goes into a scaler
    fitted on others; constant columns become 0, and so do all where there is nothing to fit on. The statistics are one row."""
    one = fitted_on.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = df.crossJoin(F.broadcast(one))
    return scaled.withColumns({c: F.coalesce(F.round((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), 4), F.lit(0.0)) for c in columns}).drop(*one.columns)


def label_of_code(code: Column) -> Column:
    """1 for a review whose class says that it was made up, else 0, also where there is no class."""
    return F.coalesce(code == FAKE_CODE, F.lit(False)).cast("int")


def fake_share_by(df: DataFrame, by: str, label: str) -> DataFrame:
    """(by, n, fakes, pct): reviews of each value and how many in a hundred are fake; rows without a label are left out."""
    return df.where(F.col(label).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("fakes"), F.round(F.avg(label) * 100, 4).alias("pct"))


def ensemble(df: DataFrame) -> DataFrame:
    """With ensemble_score, confidence by agreement, is_fake_predicted."""
    gap = F.round(F.abs(F.col("xgboost_score") - F.col("bert_score")), 6)
    score = F.round(ENSEMBLE["xgboost"] * F.col("xgboost_score") + ENSEMBLE["bert"] * F.col("bert_score"), 6)
    return df.withColumns({"ensemble_score": score, "confidence": F.when(gap < ENSEMBLE["high"], "high").when(gap < ENSEMBLE["medium"], "medium").otherwise("low"), "is_fake_predicted": (score > ENSEMBLE["fake"]).cast("int")})


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, p, q, before_p, before_q): positives and negatives at each score and above it."""
    by = df.groupBy(score).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    return running(by, score, ["p", "q"], descending=True)


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp) of every distinct threshold, from counts by score within ranges of scores."""
    return _by_score(df, label, score).select(score, (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_q") + F.col("q")).alias("fp"))


def metrics(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """accuracy, precision, recall, f1 and AUC (by the trapezoids between ROC points)."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    one = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count("*").alias("n"))
    area = F.sum(F.col("q") * (2 * F.col("before_p") + F.col("p"))) / 2.0
    auc = _by_score(df, label, score).agg((F.try_divide(area, F.sum("p") * F.sum("q"))).alias("auc"))
    return one.crossJoin(F.broadcast(auc)).selectExpr("round((n - fp - fn) / n, 6) as accuracy", "round(try_divide(tp, tp + fp), 6) as precision", "round(try_divide(tp, tp + fn), 6) as recall", "round(try_divide(2 * tp, 2 * tp + fp + fn), 6) as f1", "round(auc, 6) as auc")
