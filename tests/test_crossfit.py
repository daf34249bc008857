"""Cross-fitted scores: each from the model of the other folds, and none from a model that saw the row."""

from __future__ import annotations

import random

import pytest

from martlens.operators import crossfit, reviews, training


@pytest.fixture(scope="module")
def planted(spark):
    """Fakes shout and use words of their own; some rows lack a label, a text or a rating."""
    rng = random.Random(3)
    rows = []
    for i in range(240):
        fake = i % 2
        words = rng.choices(["great", "buy", "now", "cheap"] if fake else ["table", "works", "after", "month", "fine"], k=rng.randrange(4, 30))
        rows.append((i, " ".join(words) + ("!!!" if fake else "."), 5 if fake else rng.randrange(1, 6), fake))
    rows += [(300, None, None, 1), (301, "no label", 3, None), (None, "no id", 3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, rating int, is_fake int").cache()


def test_scores_learn_the_rule(planted):
    got = crossfit.blended_scores(planted)
    assert got.count() == planted.count() and got.where("xgboost_score is null or bert_score is null or ensemble_score not between 0 and 1").count() == 0
    measured = reviews.metrics(got.where("doc_id < 240"), "is_fake", "is_fake_predicted", "ensemble_score").first()
    assert measured["accuracy"] > 0.95 and measured["auc"] > 0.97


def test_each_fold_is_scored_by_the_model_of_the_others(planted):
    rows = training.with_features(planted.withColumn("fold", crossfit.fold_of("doc_id", 3))).cache()
    got = {(r["doc_id"], r["fold"]): round(r["xgboost_score"], 6) for r in crossfit.cross_fitted(rows, lambda df: training.fit(df, "logreg", "is_fake"), training.scores_or_zero, "is_fake", "fold", 3).collect()}
    for f in range(3):
        model = training.fit(rows.where(f"fold <> {f} and is_fake is not null"), "logreg", "is_fake")
        want = {(r["doc_id"], f): round(r["score"], 6) for r in training.predict(model, rows.where(f"fold = {f}")).collect()}
        assert {k: v for k, v in got.items() if k[1] == f} == want and want


def test_labels_do_not_leak(spark):
    """Labels by chance: a forest knows those it learned by heart, and nothing of others."""
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, " ".join("".join(rng.choices("abcdefghij!?A1", k=rng.randrange(1, 9))) for _ in range(rng.randrange(5, 60))), rng.randrange(1, 6), rng.randrange(2)) for i in range(300)], "doc_id long, text string, rating int, is_fake int")
    featured = training.with_features(rows).cache()
    own = training.predict(training.fit(featured, "forest", "is_fake"), featured)
    assert reviews.metrics(own, "is_fake", "predicted", "score").first()["auc"] > 0.9
    got = crossfit.blended_scores(rows)
    assert all(abs(reviews.metrics(got.withColumnRenamed(c, "s"), "is_fake", "is_fake_predicted", "s").first()["auc"] - 0.5) < 0.15 for c in ("xgboost_score", "bert_score", "ensemble_score"))


def test_without_labels_there_is_no_model(planted):
    none = crossfit.blended_scores(planted.selectExpr("doc_id", "text", "rating", "cast(null as int) as is_fake").limit(5))
    assert {(r["xgboost_score"], r["bert_score"]) for r in none.collect()} == {(0.0, 0.0)}
    assert crossfit.blended_scores(planted.limit(0)).collect() == []
