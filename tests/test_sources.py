"""Files in and out, result pages and robots rules on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.operators import training
from martlens.sources import files, pages

SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("price", T.StringType())])


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def test_newest_csv(spark, tmp_path):
    assert files.newest_csv(spark, str(tmp_path / "none"), "a", SCHEMA).count() == 0
    write(tmp_path / "a_products_20240101.csv", "title,price\nold,1\n")
    write(tmp_path / "a_products_20240301.csv", 'title,price\n"new, ""quoted""\nline",2\n')
    write(tmp_path / "b_products_20250101.csv", "title,price\nother,3\n")
    assert [tuple(r) for r in files.newest_csv(spark, str(tmp_path), "a", SCHEMA).collect()] == [('new, "quoted"\nline', "2")]
    write(tmp_path / "a_latest.csv", "﻿title,price\nlatest,4\n")
    assert [tuple(r) for r in files.newest_csv(spark, str(tmp_path), "a", SCHEMA).collect()] == [("latest", "4")]


def test_latin_1_is_read_where_utf_8_fails(spark, tmp_path):
    write(tmp_path / "x.csv", "title,price\nécran,5 €\n".replace("€", "e"), "latin1")
    write(tmp_path / "y.csv", "title,price\nécran,5\n")
    for name in "xy":
        assert files.read_csv(spark, str(tmp_path / f"{name}.csv"), SCHEMA).first()["title"] == "écran"


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_required(spark, str(tmp_path / "no.csv"), SCHEMA)
    write(tmp_path / "is.csv", "title,price\na,1\n")
    found = files.read_or_empty(spark, {"is": (str(tmp_path / "is.csv"), SCHEMA), "no": (str(tmp_path / "no.csv"), SCHEMA)})
    assert found["is"].count() == 1 and found["no"].count() == 0 and found["no"].schema == SCHEMA


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", None if i % 2 else float("nan"), i % 3 == 0) for i in range(250)], "id long, name string, x double, is_fake boolean")
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 250
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 250
    files.write_sample(df, "id", str(tmp_path / "sample"))
    assert sorted(int(r["id"]) for r in spark.read.csv(str(tmp_path / "sample"), header=True).collect()) == list(range(100))
    files.write_fakes(df, str(tmp_path / "fakes"))
    assert spark.read.csv(str(tmp_path / "fakes"), header=True).count() == 84
    files.write_versioned(df, str(tmp_path / "v"), "20240101")
    assert spark.read.parquet(str(tmp_path / "v" / "latest")).count() == spark.read.parquet(str(tmp_path / "v" / "20240101")).count() == 250
    assert files.with_bom_removed(df.withColumnRenamed("id", "﻿id")).columns == df.columns
    assert files.read_features(spark, str(tmp_path / "v" / "latest"))[1] == 250
    files.write_matches(df.limit(0), {"tn": df, "fr": df.limit(0)}, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m" / "unmatched_tn"), header=True).count() == 250
    assert spark.read.schema(df.schema).csv(str(tmp_path / "m" / "price_comparison"), header=True).count() == 0
    records = [json.loads(r[0]) for r in files.as_json_records(df.limit(3)).collect()]
    assert all("x" not in r for r in records)
    arrays = [json.loads(r["array"]) for r in files.as_json_arrays(df, "id", 100).orderBy("part").collect()]
    assert [len(a) for a in arrays] == [100, 100, 50] and [r["id"] for a in arrays for r in a] == list(range(250))


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan")), ("c", None)], "k string, v double")
    assert files.report({"Means": df}) == "Means\n-----\nk\tv\na\t1.5\nb\t-\nc\t-\n"
    assert json.loads(files.statistics_json({"means": df})) == {"means": [{"k": "a", "v": 1.5}, {"k": "b"}, {"k": "c"}]}


def test_items_by_the_first_opening_that_is_there(spark):
    html = ['<ul><li class="x product-item">1</li><li class="product-item">2</li></ul><div class="product-container">3</div>', '<div class="product-container">4</div>', "<p>none</p>", None]
    rows = spark.createDataFrame(list(enumerate(html)), "page long, html string")
    got = [(r["page"], r["i"], "".join(c for c in r["item"] if c.isdigit())) for r in pages.items(rows, "page").orderBy("page", "i").collect()]
    assert got == [(0, 0, "1"), (0, 1, "23"), (1, 0, "4")]


def test_records_of_a_shop(spark):
    html = '<article data-product-id="9"><a href="/p/9">A <b>name</b></a></article><article><a href="https://o/77.html">B</a><span class="final-price">1.234,50 €</span></article><article><p>no title</p></article>'
    found = pages.items(spark.createDataFrame([(1, html)], "page long, html string"), "page")
    rows = [r.asDict() for r in pages.shop_records(found, "https://s", "listed", millimes=False).orderBy("i").collect()]
    assert [(r["id"], r["title"], r["url"], r["price"], r["in_stock"], r["discount_percent"]) for r in rows] == [("9", "A <b>name</b>", "https://s/p/9", None, False, 0.0), ("77", "B", "https://o/77.html", 1234.5, False, 0.0)]


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.x/in/1?q",), ("https://a.x/in/ok/2",), ("https://a.x",), ("https://b.x/in/1",), (None,)], "url string")
    rules = spark.createDataFrame([("a.x", 0, "/in/ok", True), ("a.x", 1, "/in", False), ("a.x", 2, "", False)], "host string, place int, path string, allow boolean")
    assert {r["url"]: r["allowed"] for r in pages.allowed(urls, rules).collect()} == {"https://a.x/in/1?q": False, "https://a.x/in/ok/2": True, "https://a.x": True, "https://b.x/in/1": True, None: True}


def test_page_status(spark):
    rows = spark.createDataFrame([(1, "<title>404 Not Found</title>"), (2, "<p>404 things</p>"), (3, "<h1>Captcha</h1>"), (4, None)], "page_id long, html string")
    assert {r["page_id"]: r["status"] for r in pages.page_status(rows).collect()} == {1: "missing", 2: "read", 3: "blocked", 4: "read"}


def test_models_on_disk(spark, tmp_path):
    texts = [(i, "buy now!!! " * (1 + i % 4) if i % 2 else f"calm words number {i}.", 5 if i % 2 else 3, i % 2) for i in range(40)]
    rows = training.with_features(spark.createDataFrame(texts, "doc_id long, text string, rating int, is_fake int"))
    model = training.fit(rows, "logreg", "is_fake")
    training.save(model, spark.createDataFrame([("accuracy", 1.0)], "key string, value double"), str(tmp_path / "m"))
    assert training.load_first(spark, [str(tmp_path / "no")]) is None
    again = training.load_first(spark, [str(tmp_path / "no"), str(tmp_path / "m" / "model")])
    want = [round(r[0], 9) for r in training.predict(model, rows).orderBy("doc_id").select("score").collect()]
    assert [round(r[0], 9) for r in training.scores_or_zero(again, rows).orderBy("doc_id").select("xgboost_score").collect()] == want
    assert {r[0] for r in training.scores_or_zero(None, rows).select("xgboost_score").collect()} == {0.0}
    assert training.present(rows.drop("rating", "digit_count")) == [f for f in training.FEATURES if f not in ("rating", "digit_count")]
    assert rows.where("doc_id = 0").select(F.col("is_extreme_rating")).first()[0] == 0
