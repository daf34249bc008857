"""Runs, alerts and data quality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def dashboard(runs: DataFrame, first: str, last: str) -> DataFrame:
    """(state, n, pct) of the runs that ended between two days, both included."""
    rows = runs.where(F.to_date("end_time").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("state").agg(F.count("*").alias("n"))
    return rows.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def daily_report(runs: DataFrame, slow: float) -> DataFrame:
    return runs.groupBy(F.to_date("end_time").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("duration") > slow).alias("slow"), F.round(F.avg("duration"), 4).alias("avg_duration"))


def failure_storms(runs: DataFrame, minutes: int = 60, limit: int = 3) -> DataFrame:
    """(hour, failures) of the windows with more than ``limit`` failures; windows are counted, not rows compared."""
    rows = runs.where(F.col("state") == "failed").groupBy(F.window("end_time", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("failures"))
    return rows.where(F.col("failures") > limit).select(F.col("w.start").alias("window_start"), "failures")


def rolling_anomalies(runs: DataFrame, above: float, days: int = 7) -> DataFrame:
    """(day, n, rolling) of the days whose count is over ``above`` away from the mean of the last days, themselves included."""
    daily = runs.groupBy(F.to_date("end_time").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)  # one row for each day
    return daily.withColumn("rolling", F.round(F.avg("n").over(w), 4)).where(F.abs(F.col("n") - F.col("rolling")) > above)


def percentiles(runs: DataFrame, by: str, column: str) -> DataFrame:
    found = quantiles(runs, column, (0.5, 0.95, 0.99), [by])
    return found.select(by, *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def drift(before: DataFrame, after: DataFrame, key: str, value: str, limit: float = 0.15) -> DataFrame:
    """(drift, alert): mean relative change of metrics that both have."""
    both = before.select(key, F.col(value).alias("a")).join(after.select(key, F.col(value).alias("b")), key)
    return both.agg(F.round(F.avg(F.try_divide(F.abs(F.col("b") - F.col("a")), F.abs(F.col("a")))), 4).alias("drift")).withColumn("alert", F.col("drift") > limit)


def sla(measures: Mapping[str, tuple[Column, str, float]], df: DataFrame) -> DataFrame:
    """(name, value, bound, ok) of aggregates against their bounds; sense is ``max`` or ``min``."""
    one = df.agg(*[F.round(c, 4).cast("double").alias(n) for n, (c, _, _) in measures.items()])
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(float(b)).alias("bound"), (F.col(n) <= b if s == "max" else F.col(n) >= b).alias("ok")) for n, (_, s, b) in measures.items()]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def quality_scores(df: DataFrame, key: str) -> DataFrame:
    """(completeness, validity, consistency): shares of non-null cells, of cells that do not say 'invalid', and of distinct keys."""
    cells = F.count("*") * len(df.columns)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    bad = sum((F.count_if(F.lower(F.col(c).cast("string")) == "invalid") for c in df.columns), F.lit(0))
    return df.agg(F.round(1 - nulls / cells, 6).alias("completeness"), F.round(1 - bad / cells, 6).alias("validity"), F.round(F.count_distinct(key) / F.count("*"), 6).alias("consistency"))


def classify_error(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("timeout"), "timeout").when(low.contains("403") | low.contains("401"), "credentials").when(low.contains("connection"), "network").otherwise("scraper")


def within_bounds(measures: Mapping[str, tuple[Column, float | None, float | None]], df: DataFrame) -> DataFrame:
    """(name, value, low, high, ok) of aggregates against a lower and an upper bound, either of which may be None."""
    one = df.agg(*[F.round(c, 4).cast("double").alias(n) for n, (c, _, _) in measures.items()])
    bound = lambda b: F.lit(b).cast("double")
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), bound(lo).alias("low"), bound(hi).alias("high"), (F.coalesce(F.col(n) >= bound(lo), F.lit(True)) & F.coalesce(F.col(n) <= bound(hi), F.lit(True))).alias("ok")) for n, (_, lo, hi) in measures.items()]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def volume(df: DataFrame, low: int = 300, high: int = 500) -> DataFrame:
    """Whether a table's number of rows lies between two bounds."""
    return within_bounds({"volume": (F.count("*"), low, high)}, df)


def row_quality(df: DataFrame) -> DataFrame:
    """quality_scores with consistency by whole rows: 1 less the share of rows that repeat another."""
    key = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)]), {"ignoreNullFields": "false"}), 256)
    rows = df.withColumn("_row", key)
    kinds = rows.groupBy("_row").agg(F.count("*").alias("n"))  # repeats meet as counts
    one = kinds.agg(F.round(1 - (F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("consistency"))
    return quality_scores(df, df.columns[0]).drop("consistency").crossJoin(F.broadcast(one))


def degraded(accuracy: DataFrame, baseline: float = 0.85, slack: float = 0.05) -> DataFrame:
    """(accuracy, baseline, degradation, alert) of a table of accuracies."""
    a = F.col("accuracy")
    return accuracy.select(a, F.lit(baseline).alias("baseline"), F.round(F.lit(baseline) - a, 6).alias("degradation"), (a < baseline - slack).alias("alert"))


def score_distribution(df: DataFrame, score: str, low: float = 0.1, high: float = 0.9, sure: float = 0.95, most: float = 0.1) -> DataFrame:
    """(mean, sure, share, mean_alert, share_alert): whether mean or share of very sure scores is out of the ordinary."""
    one = df.agg(F.round(F.avg(score), 6).alias("mean"), F.count_if(F.col(score) > sure).alias("sure"), F.round(F.try_divide(F.count_if(F.col(score) > sure), F.count(score)), 6).alias("share"))
    return one.select("*", ((F.col("mean") > high) | (F.col("mean") < low)).alias("mean_alert"), (F.col("share") > most).alias("share_alert"))


def sliding_storms(runs: DataFrame, minutes: int = 60, every: int = 5, limit: int = 3) -> DataFrame:
    """(window_start, window_end, failures) of the sliding windows with more than ``limit`` failures, as polled every few minutes."""
    rows = runs.where(F.col("state") == "failed").groupBy(F.window("end_time", f"{minutes} minutes", f"{every} minutes").alias("w")).agg(F.count("*").alias("failures"))
    return rows.where(F.col("failures") > limit).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures")


def freshness(df: DataFrame, stamp: str, key: str, valid: Column, now: str, hours: float = 24, duplicates: float = 0.05, invalid: int = 100) -> DataFrame:
    """(age_hours, duplicate_rate, invalid, stale, duplicated, too_invalid) of a table at a point in time."""
    keys = df.groupBy(key).agg(F.count("*").alias("_n"), F.max(stamp).alias("_at"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("_bad"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("_at").cast("timestamp"))) / 3600
    one = keys.agg(F.round(age, 4).alias("age_hours"), F.round(1 - F.count("*") / F.sum("_n"), 6).alias("duplicate_rate"), F.sum("_bad").alias("invalid"))
    return one.select("*", (F.col("age_hours") > hours).alias("stale"), (F.col("duplicate_rate") > duplicates).alias("duplicated"), (F.col("invalid") > invalid).alias("too_invalid"))


def run_durations(runs: DataFrame, slow: float = 3600.0) -> DataFrame:
    """Runs (run_id, start_time, end_time, ...) with seconds and whether they are slow; null while a run goes on."""
    seconds = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    return runs.withColumn("seconds", F.round(seconds / 1_000_000, 3)).withColumn("slow", F.col("seconds") > slow)


def scraping_performance(runs: DataFrame, by: str, least: float = 0.95) -> DataFrame:
    """(by, total, success, failed, success_rate, seconds_per_item, alert) of runs (by, ok, seconds): the time of all items over the
    successful ones, null without any; ``alert`` where fewer than ``least`` succeed. A missing ``ok`` is a failure, a missing
    time takes none."""
    sums = runs.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("success"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("_s"))
    rate = F.col("success") / F.col("total")
    return sums.select(by, "total", "success", (F.col("total") - F.col("success")).alias("failed"), F.round(rate, 6).alias("success_rate"), F.round(F.try_divide("_s", "success"), 4).alias("seconds_per_item"), (rate < least).alias("alert"))
