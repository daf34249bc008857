"""What listings take on disk: they are shuffled without what they share with others, and numbered only where numbers are told."""

from __future__ import annotations

import random

import pytest
from oracle import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

from martlens.functions.prices import clean_price
from martlens.operators import catalog
from martlens.plans.queries import ORACLE_SQL, QUERIES
from martlens.sources import tables


def stages(spark) -> dict[int, int]:
    """Bytes that each stage has shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}


def shuffled(spark, run) -> int:
    last = max(stages(spark), default=-1)
    run().write.format("noop").mode("overwrite").save()
    return sum(n for i, n in stages(spark).items() if i > last)


@pytest.mark.parametrize(("name", "most"), [("products_unified", 85), ("product_documents", 85), ("price_comparison", 85), ("match_tiers_and_rate", 70), ("matches_by_method", 70), ("price_diff_histogram", 70)])
def test_bytes_shuffled_for_each_line_item(spark, sf, name, most):
    lines = tables.table(spark, sf, "lineitem").count()
    assert shuffled(spark, lambda: QUERIES[name](spark, sf)) / lines < most


@pytest.mark.parametrize("name", ["match_tiers_and_rate", "matches_by_method", "price_diff_histogram", "price_diff_stats"])
def test_counted_matches_need_no_numbers(spark, sf, name, monkeypatch):
    monkeypatch.setattr(catalog, "range_marks", None)
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(connect(sf), ORACLE_SQL[name])


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory) -> str:
    """Parts that repeat or are not there; suppliers and prices that lack; listings of one url at one time."""
    folder = str(tmp_path_factory.mktemp("odd"))
    t = {n: tables.table(spark, sf, n) for n in ("lineitem", "part", "supplier", "nation", "region")}
    key = F.col("p_partkey")
    t["part"] = t["part"].where(key % 7 != 0)
    t["part"] = t["part"].union(t["part"].where(key % 3 == 0)).union(t["part"].limit(1).withColumn("p_partkey", F.lit(None).cast("long")))
    line, spoilt = t["lineitem"], lambda c, n, by: F.when(F.col(c) % n != 0, F.col(by))
    line = line.withColumns({"l_partkey": spoilt("l_orderkey", 11, "l_partkey"), "l_extendedprice": spoilt("l_orderkey", 13, "l_extendedprice"), "l_suppkey": spoilt("l_orderkey", 17, "l_suppkey")})
    t["lineitem"] = line.union(line.where("l_orderkey % 4 = 0").withColumn("l_orderkey", -F.col("l_orderkey"))).union(line.where("l_orderkey % 6 = 0").withColumn("l_shipdate", F.lit(None).cast(line.schema["l_shipdate"].dataType)))
    for name, rows in t.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["products_unified", "product_documents", "consolidation_summary", "price_comparison", "match_tiers_and_rate"])
def test_odd_listings_and_parts(spark, odd, name):
    columns, rows = spark_rows(QUERIES[name](spark, odd))
    assert (columns, rows) == sql_rows(connect(odd), ORACLE_SQL[name]) and rows


def test_products_are_numbered_once_their_names_are_known(spark):
    """Blank and missing names, kinds that nothing or two equal rows are said about, urls of one time, prices out of range."""
    kinds = {0: "a mouse", 1: " ", 2: None, 3: "a keyboard", 5: "a screen"}
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(6)]), rng.randrange(40), rng.choice(["7,50", "0", "x", "2000000", "1.234,00"]), rng.randrange(3), i) for i in range(400)]
    listings = spark.createDataFrame([(k, None if k is None else u * 10 + k, p, t, i) for k, u, p, t, i in rows], "kind long, url_key long, text string, scraped_at long, row long").repartition(3)
    about = spark.createDataFrame([(k, n) for k, n in kinds.items() for _ in range(2)], "kind long, product_name string")
    run = lambda number: catalog.unify(listings.select("kind", "url_key", clean_price(F.col("text")).alias("price_value"), "scraped_at", "row"), about, ["kind"], "url_key", F.concat(F.lit("u"), "url_key"), ["row"], number)
    newest: dict[int, tuple] = {}
    for k, u, p, t, i in rows:
        if k is not None:
            newest[u * 10 + k] = min(newest.get(u * 10 + k, (1,)), (-t, i, k, {"7,50": 7.5, "1.234,00": 1234.0}.get(p)))
    kept = [(key, kinds[k], price, -t) for key, (t, _, k, price) in sorted(newest.items()) if price and (kinds.get(k) or "").strip()]
    columns = ["url_key", "product_name", "price_value", "scraped_at"]
    assert sorted(map(tuple, run(True).select("number", *columns, "product_url").collect())) == [(n, *row, f"u{row[0]}") for n, row in enumerate(kept, 1)] and len(kept) > 20
    assert sorted(map(tuple, run(False).select(*columns).collect())) == kept


def test_many_suppliers_are_not_broadcast(spark, sf, monkeypatch):
    plan = lambda: tables.shop_listings(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [l_suppkey" in plan()
    monkeypatch.setattr(tables, "FEW_SUPPLIERS", 2)
    assert "SortMergeJoin [l_suppkey" in plan()
    assert spark_rows(QUERIES["products_unified"](spark, sf)) == sql_rows(connect(sf), ORACLE_SQL["products_unified"])
