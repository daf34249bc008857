"""Versions of stored products: merges, the pointer, failed writes, odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from martlens.plans.queries import QUERIES
from martlens.sources import files, published
from martlens.sources.shared import new_folder


def rows(spark, listed):
    return spark.createDataFrame(listed, "url string, price double, at string, n long").withColumn("at", F.to_timestamp("at"))


def merge(df, folder, stamp):
    return published.merge(df, folder, stamp, "url", "at", ["n"], buckets=16)


def plain(df):
    return sorted(((r["url"], r["price"], str(r["at"]), r["n"]) for r in df.collect()), key=str)


def best(listed):
    out = {}
    for url, price, at, n in listed:
        if url is not None and (url not in out or (at is not None, at or "", -n) > (out[url][2] is not None, out[url][2] or "", -out[url][3])):
            out[url] = (url, price, at, n)
    return sorted(((u, p, str(None if a is None else a), n) for u, p, a, n in out.values()), key=str)


def test_merges_equal_recomputation_in_any_order(spark):
    rng = random.Random(5)
    numbers = iter(range(10**6))
    scrape = lambda: [(rng.choice([None, "", "hot", "hot", *[f"u{i}" for i in range(40)]]), rng.choice([None, 1.0, 2.0]), rng.choice([None, *[f"2024-01-0{d} 00:00:00" for d in range(1, 8)]]), next(numbers)) for _ in range(80)]
    scrapes = [scrape() for _ in range(4)]
    for order in (scrapes, scrapes[::-1]):
        folder = new_folder(spark, "t")
        for i, s in enumerate(order):
            merge(rows(spark, s), folder, f"v{i}")
        assert plain(published.read_newest(spark, folder)) == best(sum(scrapes, []))


def test_only_touched_buckets_are_written_and_old_versions_stay(spark):
    folder = new_folder(spark, "t")
    merge(rows(spark, [(f"u{i}", 1.0, "2024-01-01 00:00:00", i) for i in range(200)]), folder, "v0")
    before = published.read_newest(spark, folder)
    assert merge(rows(spark, [("u7", 9.0, "2024-02-01 00:00:00", 0)]), folder, "v1") == 1
    assert len([n for n in files.listed(spark, f"{folder}/v1") if n.startswith("bucket=")]) == 1
    assert published.version(spark, folder) == "v1"
    after = {r["url"]: r["price"] for r in published.read_newest(spark, folder).collect()}
    assert len(after) == 200 and after["u7"] == 9.0 and sum(after.values()) == 208
    assert before.where("url = 'u7'").first()["price"] == 1.0  # read by its own files
    found = published.changes(before, published.read_newest(spark, folder), "url", "price").groupBy("change").count().collect()
    assert {r[0]: r[1] for r in found} == {"same": 199, "changed": 1}


def test_rows_are_shuffled_once_by_their_bucket(spark, sf, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **k))
    folder = new_folder(spark, "t")
    for i in range(2):
        merge(rows(spark, [(f"u{n}", float(i), f"2024-01-0{i + 1} 00:00:00", n) for n in range(50)]), folder, f"v{i}")
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 1, 1]
    plans.clear()
    assert QUERIES["products_merged"](spark, sf).count() > 0
    assert plans and not [p for p in plans if "Exchange hashpartitioning(product_url" in p]


def test_a_failed_write_leaves_the_version_before(spark):
    folder = new_folder(spark, "t")
    merge(rows(spark, [("a", 1.0, "2024-01-01 00:00:00", 0)]), folder, "v0")
    broken = rows(spark, [("a", 2.0, "2024-01-02 00:00:00", 0)]).withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        merge(broken, folder, "v1")
    with pytest.raises(Exception, match="lost"):
        published.publish(broken, folder, "v1", "url")
    assert published.version(spark, folder) == "v0" and published.read_newest(spark, folder).first()["price"] == 1.0
    merge(rows(spark, [("a", 3.0, "2024-01-03 00:00:00", 0)]), folder, "v1")  # the same name again
    assert published.read_newest(spark, folder).first()["price"] == 3.0
    with pytest.raises(ValueError):
        merge(rows(spark, [("a", 4.0, "2024-01-04 00:00:00", 0)]), folder, "v1")


def test_empty_scrapes_new_columns_and_no_table(spark):
    folder = new_folder(spark, "t")
    with pytest.raises(FileNotFoundError):
        published.read_newest(spark, folder)
    assert merge(rows(spark, []), folder, "v0") == 0 and published.read_newest(spark, folder).count() == 0
    merge(rows(spark, [("a", 1.0, None, 0), ("b", 1.0, None, 1)]), folder, "v1")
    assert merge(rows(spark, []), folder, "v2") == 0
    merge(rows(spark, [("c", 1.0, None, 0)]).withColumn("stock", F.lit("yes")), folder, "v3")
    got = published.read_newest(spark, folder)
    assert {r["url"]: r["stock"] for r in got.collect()} == {"a": None, "b": None, "c": "yes"}
    with pytest.raises(ValueError):
        published.merge(rows(spark, []), folder, "v4", "n", "at")


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    files.write_csv_with_bom(spark.createDataFrame([(1, "é"), (2, None)], "id long, name string").coalesce(1), str(tmp_path / "x"))
    part = next(p for p in (tmp_path / "x").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,name\n")
    got = files.with_bom_removed(spark.read.csv(str(tmp_path / "x"), header=True))
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [("1", "é"), ("2", None)]
