"""Alerts, rates and quantiles over the event table, robots rules and rates as of a time, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices
from ..operators import alerts
from ..operators.rates import rates_as_of
from ..sources import robots
from ..sources.tables import table
from .registry import ORACLE_SQL, query

#: A sample of each event: whether its value is over this, for so long.
OVER, HOLD_SECONDS = 2.0, 7200
#: Upper bounds of the buckets of durations.
BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]

_SAMPLES_SQL = f"s AS (SELECT event_type AS name, ts, min(value > {OVER}) AS holds, count(*) AS n FROM events GROUP BY 1, 2)"


@query(
    f"""WITH {_SAMPLES_SQL}, b AS (SELECT *, count(CASE WHEN NOT holds THEN 1 END) OVER (PARTITION BY name ORDER BY ts) AS run FROM s), r AS (SELECT *, min(ts) OVER (PARTITION BY name, run) AS since FROM b WHERE holds)
 SELECT name, since, min(CASE WHEN ts >= since + INTERVAL {HOLD_SECONDS} SECONDS THEN ts END) AS fired_at, max(ts) AS last_at, CAST(sum(n) AS BIGINT) AS samples FROM r GROUP BY name, since HAVING fired_at IS NOT NULL"""
)
def sustained_alerts(spark, sf):
    """Alerts of each kind of event whose values stay high for two hours."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("name"), "ts", (F.col("value") > OVER).alias("holds"))
    return alerts.sustained_alerts(rows, HOLD_SECONDS)


@query(
    """WITH s AS (SELECT event_type AS name, ts, max(event_id % 500) AS v, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS step FROM events GROUP BY ALL), d AS (SELECT *, lag(v) OVER (PARTITION BY name ORDER BY ts) AS p FROM s),
 u AS (SELECT *, CASE WHEN v < p THEN v ELSE v - p END AS up FROM d), ends AS (SELECT DISTINCT name, step FROM s)
 SELECT e.name, make_timestamp((e.step + 1) * 3600000000) AS at, CAST(sum(coalesce(up, 0)) - arg_min(coalesce(up, 0), ts) AS DOUBLE) AS increase, (sum(coalesce(up, 0)) - arg_min(coalesce(up, 0), ts)) / 86400.0::DOUBLE AS rate FROM ends e JOIN u ON u.name = e.name AND u.step BETWEEN e.step - 23 AND e.step GROUP BY ALL"""
)
def counter_rates(spark, sf):
    """The rate over 24 hours, each hour, of a counter with resets."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("name"), "ts", (F.col("event_id") % 500).alias("value"))
    return alerts.counter_rates(rows, 86_400, 3600).withColumn("at", F.col("at").cast("timestamp_ntz"))


def _quantile_sql(q: float) -> str:
    lows = [0.0, *BOUNDS[:-1]]
    cases = " ".join(f"WHEN list_count(list_filter(v, lambda x: x <= {b})) >= {q} * n THEN {lo} + {b - lo} * ({q} * n - list_count(list_filter(v, lambda x: x <= {lo} AND {i} > 0))) / (list_count(list_filter(v, lambda x: x <= {b})) - list_count(list_filter(v, lambda x: x <= {lo} AND {i} > 0)))" for i, (lo, b) in enumerate(zip(lows, BOUNDS, strict=True)))
    return f"round(CASE {cases} ELSE {BOUNDS[-1]} END, 6)"


@query(f"WITH g AS (SELECT event_type AS name, list(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) SELECT name, CAST(n AS BIGINT) AS total, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95, {_quantile_sql(0.999)} AS p999 FROM g")
def bucket_quantiles(spark, sf):
    """Quantiles of durations from histograms of a day each, merged."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("ts").cast("date").alias("day"), "value")
    whole = alerts.merged(alerts.histograms(rows, ["name", "day"], "value", BOUNDS), ["name"])
    return whole.select("name", "total", *[F.round(alerts.bucket_quantile(q, BOUNDS), 6).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.999, "p999"))])


#: What hosts of one kind say; the group of all agents comes last, and the first of its rules that fits decides.
ROBOTS = "# crawl gently\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/6 # some\nDisallow: /en/\nDisallow: /fr/\nAllow: /fr/1\n"


@query(ORACLE_SQL["robots_allowed"])
def robots_txt_allowed(spark, sf):
    """Pages that the robots.txt of their host allows; hosts that end in .com have one."""
    urls = table(spark, sf, "pages").select("page_id", "url")
    hosts = urls.select(F.parse_url("url", F.lit("HOST")).alias("host")).distinct()
    files = hosts.select("host", F.when(F.endswith("host", F.lit(".com")), ROBOTS).alias("text"))
    return robots.allowed_by_rules(urls, robots.parsed_rules(files)).select("page_id", "allowed")


_CURRENCIES = "['TND', 'USD', 'EUR']"


@query(
    f"""WITH q AS (SELECT {_CURRENCIES}[user_id % 2 + 1] AS currency, ts, min(0.2 + value / 1000) AS rate FROM events WHERE event_type = 'error' AND extract(day FROM ts) % 4 <> 0 GROUP BY ALL),
 a AS (SELECT event_id, {_CURRENCIES}[event_id % 3 + 1] AS currency, ts, value FROM events WHERE event_type <> 'error')
 SELECT event_id, a.currency, round(CASE WHEN a.currency = 'EUR' THEN 1 WHEN a.ts - q.ts < INTERVAL 24 HOURS THEN rate WHEN a.currency = 'TND' THEN 0.304 ELSE 1 END * value, 8) AS eur, a.currency <> 'EUR' AND coalesce(a.ts - q.ts < INTERVAL 24 HOURS, false) AS quoted FROM a ASOF LEFT JOIN q ON a.currency = q.currency AND a.ts >= q.ts"""
)
def rates_with_validity(spark, sf):
    """Amounts in euros by the last quote of their currency, if it is less than a day old, else by the fixed rate, else as they are."""
    events = table(spark, sf, "events")
    pick = lambda i: F.element_at(F.array(*[F.lit(c) for c in ("TND", "USD", "EUR")]), i.cast("int") + 1)
    quotes = events.where("event_type = 'error' and day(ts) % 4 <> 0").select(pick(F.col("user_id") % 2).alias("currency"), "ts", (F.lit(0.2) + F.col("value") / 1000).alias("rate"))
    amounts = events.where("event_type <> 'error'").select("event_id", pick(F.col("event_id") % 3).alias("currency"), "ts", "value")
    rows = rates_as_of(amounts, quotes)
    rate = F.when(F.col("currency") == "EUR", 1.0).when(F.col("rate").isNotNull(), F.col("rate")).when(F.col("currency") == "TND", prices.rate(F.lit("TND"), "EUR")).otherwise(1.0)
    return rows.select("event_id", "currency", F.round(rate * F.col("value"), 8).alias("eur"), ((F.col("currency") != "EUR") & F.col("rate").isNotNull()).alias("quoted"))
