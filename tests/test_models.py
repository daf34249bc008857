"""Fitted models against what they should be: the minimum of their loss, planted features, scores of an own computation."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.operators import export, training


@pytest.fixture(scope="module")
def rows(spark):
    """Reviews that are fake where they shout, but for one in ten."""
    rng = random.Random(3)
    words = "the a good bad thing box came late early nice poor".split()
    listed = []
    for i in range(400):
        fake = i % 2
        said = " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))
        shouts = (fake == 1) != (rng.random() < 0.1)
        listed.append((i, said + "!" * (rng.randint(2, 6) if shouts else rng.randint(0, 1)), rng.randint(1, 5), fake))
    df = training.with_features(spark.createDataFrame(listed, "id long, text string, rating int, y int"))
    return df.select("id", "y", *training.FEATURES).cache()


def test_regression_is_at_the_minimum_of_its_loss(rows):
    model = training.fit(rows, "logreg", "y")
    fitted = model.stages[-1]
    table = rows.orderBy("id").toPandas()
    x, y = table[training.FEATURES].to_numpy(float), table["y"].to_numpy(float)
    spread = x.std(axis=0, ddof=1)
    w, b = np.array(fitted.coefficients), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert abs((p - y).mean()) < 1e-5  # the intercept has no penalty
    for j in np.flatnonzero(spread):
        slope = ((p - y) * x[:, j] / spread[j]).mean() + w[j] * spread[j] / len(y)
        assert abs(slope) < 1e-4, training.FEATURES[j]
    got = training.predict(model, rows).orderBy("id").toPandas()["score"].to_numpy()
    assert np.abs(got - p).max() < 1e-9


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_trees_find_the_planted_feature(spark, rows, kind):
    train, test = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    model = training.fit(train, kind, "y")
    found = training.importances(model, spark).orderBy(F.desc("importance")).collect()
    assert found[0]["feature"] in ("exclamation_count", "sentence_count")
    assert sum(r["importance"] for r in found) == pytest.approx(1.0) and len(found) == len(training.FEATURES)
    right = training.predict(model, test).agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.75  # one label in ten is turned round


def test_collections_hold_together(spark):
    tables = {n: export.sample_collection(spark, n).collect() for n in export.SAMPLE_COLLECTIONS}
    users = {r["_id"] for r in tables["users"]}
    assert all(len({r["_id"] for r in rows}) == len(rows) for rows in tables.values())
    assert {r["user_id"] for n in ("user_profiles", "search_history") for r in tables[n]} <= users
    assert {r["role"] for r in tables["users"]} == {"admin", "user"} and {r["currency"] for r in tables["stores"]} == {"TND", "EUR"}


def test_searches_and_stores_without_products(spark):
    searches = spark.createDataFrame([("s1", "u", "HP laptop"), ("s2", "u", ""), ("s3", "u", None), ("s4", "u", "none such")], "_id string, user_id string, query string")
    products = spark.createDataFrame([("laptop hp 15",), ("hp mouse",), (None,)], "product_name_normalized string")
    assert {r["_id"]: r["results_count"] for r in export.search_documents(searches, products).collect()} == {"s1": 1, "s2": 0, "s3": 0, "s4": 0}
    stores = export.sample_collection(spark, "stores")
    none = spark.createDataFrame([], "source string, in_stock boolean, price_value double")
    assert {(r["products"], r["in_stock"], r["mean_price"]) for r in export.store_documents(stores, none).collect()} == {(0, 0, None)}
