"""Tables that grow with the data are joined by shuffles, whatever the size of their files; what repeats is worked out once."""

from __future__ import annotations

import random

import pytest
from pyspark.ml import Pipeline

from martlens.operators import matching, reviews, stats, training
from martlens.plans.queries import QUERIES
from martlens.sources.tables import offers, shop_rows


@pytest.mark.parametrize("rows", [offers, shop_rows])
def test_parts_are_not_passed_through_the_driver(spark, sf, rows):
    plan = rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan


def test_equal_rows_go_through_the_cascade_once(spark, monkeypatch):
    met = []
    fuzzy = matching.fuzzy_matches
    monkeypatch.setattr(matching, "fuzzy_matches", lambda left, right: met.append((left.count(), right.count())) or fuzzy(left, right))
    kinds = [("s1", "silver mouse pro", "HP", {"ram": "8GB"}), (None, "silver mouse max", None, {}), ("unknown", None, "HP", {"ram": None}), ("", "inch keyboard", "HP", {"ram": "8gb", "x": "1"}), ("", "", "Dell", None)]
    frame = lambda key, n, step: spark.createDataFrame([(i * step + 3, *kinds[i % n]) for i in range(n * 7)], f"{key} long, signature string, name string, brand string, specs map<string,string>")
    got = {r["left_id"]: (r["right_id"], r["score"], r["method"], r["confidence"]) for r in matching.match_cascade(frame("left_id", 5, 2), frame("right_id", 5, 5).where("signature is null or signature <> 's1'")).collect()}
    # kinds 0: its name is close to that of kind 1; 1 and 3: their own names; 2 and 4: nothing that could match
    ratio = int(matching.NameBits(["max mouse silver"]).ratios("mouse pro silver")[0])
    first = (18, 100.0, "specs", "high") if ratio < matching.HIGH else (8, float(ratio), "fuzzy", "high")
    want = {0: first, 1: (8, 100.0, "fuzzy", "high"), 3: (18, 100.0, "fuzzy", "high")}
    assert got == {i * 2 + 3: want[i % 5] for i in range(35) if i % 5 in want}
    assert met == [(5, 4)]


@pytest.mark.parametrize(("run", "models"), [("rf_train", 1), ("cross_fitted_metrics", 6)])
def test_texts_are_read_once_for_models(spark, sf, monkeypatch, run, models):
    """What is fitted on, and what is measured, is a written table: no text is read again for it."""
    plans = []
    note = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    fit, measure = Pipeline.fit, reviews.metrics
    monkeypatch.setattr(Pipeline, "fit", lambda self, rows: note(rows) or fit(self, rows))
    monkeypatch.setattr(reviews, "metrics", lambda df, *names: note(df) or measure(df, *names))
    monkeypatch.setitem(training.ESTIMATORS, "forest", training.ESTIMATORS["logreg"])
    assert QUERIES[run](spark, sf).count() == 1 and len(plans) == models + 1
    assert not {word for p in plans for word in ("regexp_count", "UDF(", "Join", "Window") if word in p}


def test_similar_texts_are_found_without_writing_other_pairs(spark, monkeypatch):
    for name, n in (("LEFT_TEXTS", 64), ("RIGHT_TEXTS", 16), ("PAIRS_AT_ONCE", 100)):
        monkeypatch.setattr(stats, name, n)
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", " ", "The", *[" ".join(rng.choice(["the", "The", *"abcdefghijkl"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]])
    left, right = ([(rng.choice([None, *range(150)]), text()) for _ in range(n)] for n in (200, 40))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = stats.token_overlaps(frame(left, "doc_id"), frame(right, "item_id"), "doc_id", "item_id", 0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    words = lambda t: set((t or "").lower().split())
    want = [(i, j, round(len(a & b) / len(a | b), 6)) for i, s in left for j, t in right for a, b in [(words(s), words(t))] if a & b and len(a & b) / len(a | b) >= 0.2]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 100
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert stats.token_overlaps(frame(left, "doc_id"), frame([], "item_id"), "doc_id", "item_id", 0.2).count() == 0
