"""Alerts, rates and bucket quantiles against plain recomputations; the stream of alerts against its batch form."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.operators import alerts
from martlens.streaming.alerts import sustained_stream

T0 = dt.datetime(2024, 1, 1)
SAMPLES = "name string, ts timestamp, holds boolean"


def samples(rng, n, names="ab", spread=4000):
    return [(rng.choice(names), T0 + dt.timedelta(seconds=rng.randrange(spread)), rng.choice([True] * 12 + [False, None])) for _ in range(n)]


def plain_alerts(rows, hold):
    out = []
    for name in {r[0] for r in rows}:
        at = {}
        for n, ts, holds in rows:
            if n == name and ts is not None:
                was = at.get(ts, (True, 0))
                at[ts] = (was[0] and bool(holds), was[1] + 1)
        run = []
        for ts in [*sorted(at), None]:
            if ts is not None and at[ts][0]:
                run.append(ts)
                continue
            fired = [t for t in run if (t - run[0]).total_seconds() >= hold]
            if fired:
                out.append((name, run[0], fired[0], run[-1], sum(at[t][1] for t in run)))
            run = []
    return sorted(out)


@pytest.mark.parametrize("piece", [7, 60, 100_000])
def test_alerts_over_borders_of_pieces(spark, piece):
    rng = random.Random(piece)
    rows = [*samples(rng, 900), *[("long", T0 + dt.timedelta(seconds=5 * i), True) for i in range(300)], ("never", T0, False), ("a", None, True)]
    got = alerts.sustained_alerts(spark.createDataFrame(rows, SAMPLES).repartition(3), 40, piece).collect()
    assert sorted(map(tuple, got)) == plain_alerts(rows, 40) and any(r["name"] == "long" for r in got)
    assert alerts.sustained_alerts(spark.createDataFrame([], SAMPLES), 40).collect() == []


def test_stream_of_alerts_equals_batch(spark, tmp_path):
    """Rows come in disorder, some late but within the watermark; those beyond it are dropped."""
    rng = random.Random(5)
    rows = sorted(samples(rng, 600, spread=6000), key=lambda r: (r[1].timestamp() + rng.uniform(0, 500), r[0]))
    late = ("a", T0 - dt.timedelta(days=1), False)
    end = [(n, T0 + dt.timedelta(seconds=20_000), False) for n in "ab"]
    parts = [rows[i : i + 100] for i in range(0, 600, 100)]
    for i, part in enumerate([*parts, [late], end, [("z", T0 + dt.timedelta(seconds=40_000), False)]]):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    read = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = sustained_stream(read, 40)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [r[:3] for r in plain_alerts(rows, 40)] and len(got) > 3


def test_rates_with_resets(spark):
    rng = random.Random(7)
    rows, value = [], 0
    for second in range(0, 5000, 3):
        if rng.random() < 0.7:
            value = 0 if rng.random() < 0.02 else value + rng.randrange(5)
            rows.append((rng.choice("pq"), T0 + dt.timedelta(seconds=second), value))
    got = alerts.counter_rates(spark.createDataFrame([*rows, ("p", None, 3), ("p", T0, None)], "name string, ts timestamp, value long").repartition(3), 300, 60)
    want = {}
    for name in "pq":
        own = [(int((t - T0).total_seconds()), v) for n, t, v in rows if n == name]
        for step in {s // 60 for s, _ in own}:
            inside = [v for s, v in own if step - 4 <= s // 60 <= step]
            want[name, T0 + dt.timedelta(seconds=60 * (step + 1))] = sum(b if b < a else b - a for a, b in zip(inside, inside[1:]))
    assert {(r["name"], r["at"]): r["increase"] for r in got.collect()} == want
    assert got.where(F.abs(F.col("rate") - F.col("increase") / 300) > 1e-12).count() == 0


def test_histograms_merge_and_quantiles_lie_in_their_bucket(spark):
    rng = np.random.default_rng(2)
    bounds = [0.5, 1.0, 2.0, 8.0]
    values = [float(x) for x in rng.exponential(2.0, 500)]
    rows = spark.createDataFrame([("k", i % 7, x) for i, x in enumerate(values)] + [("none", 0, None)], "name string, day int, value double")
    parts = alerts.histograms(rows, ["name", "day"], "value", bounds)
    whole, once = (df.orderBy("name").collect() for df in (alerts.merged(parts, ["name"]), alerts.histograms(rows, ["name"], "value", bounds)))
    assert whole == once
    for q in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0):
        got = {r["name"]: r["v"] for r in alerts.merged(parts, ["name"]).select("name", alerts.bucket_quantile(q, bounds).alias("v")).collect()}
        assert got["none"] is None
        true = float(np.quantile(values, q, method="inverted_cdf"))
        i = int(np.searchsorted(bounds, true))
        low, high = ([0.0, *bounds][i], bounds[i]) if i < len(bounds) else (bounds[-1], bounds[-1])
        assert low <= got["k"] <= high
