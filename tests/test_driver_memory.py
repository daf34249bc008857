"""Matched products at size: rows meet what their kinds have found without joins by id, and what is read again is a written table."""

from __future__ import annotations

import re

import pytest
from oracle import connect, spark_rows, sql_rows

from martlens.operators import stats
from martlens.plans.queries import ORACLE_SQL, QUERIES
from martlens.sources import shared


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tables_of(df) -> set[str]:
    return {re.sub(r"-[0-9a-f]{32}$", "", f.split("/")[-2]) for f in df.inputFiles()}


@pytest.mark.parametrize("name", ["price_comparison", "unmatched_left"])
def test_left_rows_meet_their_kinds_without_a_shuffle(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_products_with_ids_read_their_listings_once(spark, sf):
    got = QUERIES["product_documents"](spark, sf)
    assert tables_of(got) == {"latest"} and "SortMergeJoin" not in plan_of(got)


@pytest.mark.parametrize("name", ["price_diff_stats", "price_diff_histogram"])
def test_differences_are_worked_out_once(spark, sf, name):
    assert tables_of(QUERIES[name](spark, sf)) == {"differences"}


def test_shares_are_of_the_counts(spark):
    got = stats.counts_by(spark.range(20, numPartitions=3).selectExpr("id % 3 as k"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(0, 7, 35.0), (1, 7, 35.0), (2, 6, 30.0)]
    assert plan_of(got).count("Range (0, 20") == 1 or "ReusedExchange" in plan_of(got)


@pytest.mark.parametrize("name", ["price_comparison", "unmatched_left", "unmatched_right", "product_matches", "product_documents"])
def test_many_kinds_are_not_broadcast(spark, sf, name, monkeypatch):
    monkeypatch.setattr(shared, "FEW", 2)
    got = QUERIES[name](spark, sf)
    assert "SortMergeJoin" in plan_of(got)
    assert spark_rows(got) == sql_rows(connect(sf), ORACLE_SQL[name])


def test_packed_rows_are_not_judged_by_their_files(spark):
    rows = shared.packed(spark.range(1000), "rows")
    assert "SortMergeJoin" in plan_of(rows.join(shared.packed(spark.range(10), "rows"), "id"))
    assert "BroadcastHashJoin" in plan_of(rows.join(shared.few(shared.packed(spark.range(10), "rows")), "id"))
