"""Small cases of functions and operators, ties and missing values included."""

from __future__ import annotations

import itertools

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from martlens.functions import prices, text
from martlens.operators import catalog, matching, reviews, training
from martlens.streaming.events import run_available, tumbling


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_price(spark):
    got = column(spark, ["1.234,50 EUR", "1,234.50", "12,5", "99", "abc", "", None, "2000000", "-5"], prices.clean_price)
    assert got == [1234.5, 1234.5, 12.5, 99.0, None, None, None, None, None]


def test_names(spark):
    assert column(spark, ["  Écran  HP (24\") ", None, ""], text.normalize_name) == ["ecran hp 24", "", ""]
    assert column(spark, ["Laptop Western Digital HP", "zzz 12", "12 ab", None], text.extract_brand) == ["WESTERN DIGITAL", "ZZZ", "Unknown", "Unknown"]


def test_latest_by_url(spark):
    rows = spark.createDataFrame([("u", "2024-01-01", 1), ("u", "2024-01-02", 2), ("u", "2024-01-02", 3), ("v", None, 4)], "product_url string, scraped_at string, x int")
    got = {r["product_url"]: r["x"] for r in catalog.latest_by_url(rows, ["x"]).collect()}
    assert got == {"u": 2, "v": 4}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fuzzy_matches_equal_brute_force(spark):
    names = ["hp laptop 15 silver", "hp laptop 15", "dell screen 24", "dell 24 screen", "asus rog mouse", "asus mouse", "acer nitro five", ""]
    left = [(i, n, (n.split() or ["none"])[0], n) for i, n in enumerate(names[::2])]
    right = [(i, n, (n.split() or ["none"])[0], n) for i, n in enumerate(names[1::2])]
    found = matching.fuzzy_matches(
        spark.createDataFrame(left, "left_id int, name string, brand string, signature string"), spark.createDataFrame(right, "right_id int, name string, brand string, signature string")
    )
    got = {r["left_id"]: (r["right_id"], r["score"]) for r in found.collect()}
    want = {}
    for (i, a, brand_a, _), (j, b, brand_b, _) in itertools.product(left, right):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        if brand_a == brand_b and a and b:
            score = round(200 * _lcs(a, b) / (len(a) + len(b)))
            if score >= matching.ACCEPT and score > want.get(i, (0, 0))[1]:
                want[i] = (j, score)
    assert got == want


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tumbling(events).collect()))


@pytest.mark.parametrize("kind", ["logreg", "forest", "boosted"])
def test_models_learn_a_planted_rule(spark, kind, monkeypatch):
    monkeypatch.setitem(training.ESTIMATORS, "boosted", lambda n: GBTClassifier(maxIter=5, maxDepth=3, seed=42, featuresCol="_features", labelCol="_label"))
    texts = [("buy now!!! " * (1 + i % 4), 5, 1) if i % 2 else (" ".join(f"word{j}" for j in range(3 + i % 30)) + ".", i % 5, 0) for i in range(120)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)] + [(200, None, None, 1), (201, "no label", 3, None)], "doc_id long, text string, rating int, is_fake int")
    rows = training.with_features(rows)
    model = training.fit(rows.where("doc_id % 3 <> 0"), kind, "is_fake")
    scored = training.predict(model, rows)
    assert scored.count() == 122 and scored.where("score is null or score < 0 or score > 1").count() == 0
    got = reviews.metrics(scored.where("doc_id % 3 = 0 and doc_id < 200"), "is_fake", "predicted", "score").first()
    assert got["accuracy"] > 0.95 and got["auc"] > 0.95
    if kind != "logreg":
        found = training.importances(model, spark).collect()
        assert [r["feature"] for r in found] == training.FEATURES and abs(sum(r["importance"] for r in found) - 1) < 1e-6


def test_t_test_without_a_group_or_variance(spark):
    from martlens.operators import stats

    df = lambda rows: spark.createDataFrame(rows, "x double, f boolean")
    for rows in ([], [(1.0, True), (2.0, True)], [(1.0, True), (1.0, False), (1.0, True)]):
        got = stats.t_test(df(rows), "x", F.col("f")).first()
        assert got["t"] is None and got["p_value"] is None
    far = stats.t_test(df([(float(i % 3), True) for i in range(3000)] + [(50.0 + i % 3, False) for i in range(3000)]), "x", F.col("f")).first()
    assert far["p_value"] == 0.0
    even = stats.t_test(df([(float(i % 3), i % 2 == 0) for i in range(6)]), "x", F.col("f")).first()
    assert even["t"] == 0.0 and even["p_value"] == 1.0


def test_scraping_performance(spark):
    from martlens.operators import monitoring

    rows = [("a", True, 1.0), ("a", None, None), ("b", False, 3.0), ("c", True, 2.0), ("c", True, 4.0), (None, True, 1.0)]
    got = {r[0]: tuple(r)[1:] for r in monitoring.scraping_performance(spark.createDataFrame(rows, "k string, ok boolean, seconds double"), "k").collect()}
    assert got == {"a": (2, 1, 1, 0.5, 1.0, True), "b": (1, 0, 1, 0.0, None, True), "c": (2, 2, 0, 1.0, 3.0, False), None: (1, 1, 0, 1.0, 1.0, False)}
    assert monitoring.scraping_performance(spark.createDataFrame([], "k string, ok boolean, seconds double"), "k").count() == 0
