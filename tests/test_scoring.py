"""Ranks, splits, scoring answers, registry rules and matching blocks on small cases, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.functions import prices, text
from martlens.operators import export, lifecycle, matching, monitoring, ranks, reviews, scoring, stats


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_quantiles(spark, monkeypatch, ranges):
    monkeypatch.setattr(ranks, "RANGES", ranges)
    rng = random.Random(ranges)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, rng.random() * 9, None])) for _ in range(400)] + [("none", None), ("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in ranks.quantiles(df, "v", shares, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], shares))
    assert "none" not in got
    assert np.allclose(list(ranks.quantiles(df, "v", shares).first()), np.quantile([v for _, v in rows if v is not None], shares))
    assert list(ranks.quantiles(df.where("v > 99"), "v", (0.5,)).first()) == [None]


def test_ranges(spark):
    values = [1, 3, 3, 7, 9, 12, 40]
    for marks in ([], [3], [3, 9], [1, 3, 7, 9, 12], list(range(0, 41, 2))):
        rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", ranks.range_of(F.col("v"), marks).alias("r")).collect()
        assert [r["r"] for r in rows] == [sum(m < r["v"] for m in marks) for r in rows]


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), round(rng.random(), 1)) for _ in range(200)]
    got = reviews.metrics(spark.createDataFrame([(y, s, int(s > 0.5)) for y, s in rows], "y int, s double, p int"), "y", "p", "s").first()
    up, down = ([s for y, s in rows if y == k] for k in (1, 0))
    assert got["auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in up for b in down]), abs=1e-6)
    points = [tuple(r) for r in reviews.roc_points(spark.createDataFrame(rows, "y int, s double"), "y", "s").orderBy(F.desc("s")).collect()]
    assert points == [(s, sum(a >= s for a in up), sum(b >= s for b in down)) for s in sorted({s for _, s in rows}, reverse=True)]


def test_t_test_p_value(spark):
    rng = np.random.default_rng(1)
    for shift in (0.0, 0.4, 2.0):
        rows = [(float(v), True) for v in rng.normal(shift, 1, 30)] + [(float(v), False) for v in rng.normal(0, 1, 40)]
        got = stats.t_test(spark.createDataFrame(rows, "x double, f boolean"), "x", F.col("f")).first()
        x = np.linspace(-60, 60, 2_000_001)
        density = (1 + x * x / 68) ** (-34.5)
        assert got["p_value"] == pytest.approx(density[np.abs(x) >= abs(got["t"])].sum() / density.sum(), abs=2e-4)
    assert stats.two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_small_splits(spark):
    few = spark.createDataFrame([(i, i % 2) for i in range(7)], "k long, y int")
    got = sorted((r["part"], r["k"]) for r in reviews.sized_split(few, "k", "y").collect())
    assert got == [("test", 0), ("test", 1), *(("train", i) for i in range(7))]
    for n, labels in ((10, 2), (101, 3), (40, 1)):
        rows = spark.createDataFrame([(i, i % labels) for i in range(n)] + [(999, None)], "k long, y int")
        parts = [(r["part"], r["y"]) for r in reviews.sized_split(rows, "k", "y").collect()]
        assert len(parts) == n and sum(p == "test" for p, _ in parts) == min(max(1, int(n * 0.2)), n - 2)
        each = [sum(p == "test" and y == k for p, y in parts) for k in range(labels)]
        assert max(each) - min(each) <= 1


def test_text_scorer_failures(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else "bad" if i == 9 else f"t{i}") for i in range(12)], "i long, text string").coalesce(1)

    def scorer(texts):
        if "bad" in texts:
            raise RuntimeError("out of memory")
        return [len(t) / 10 for t in texts]

    got = [r["bert_score"] for r in scoring.text_scores(rows, scorer, batch=4).orderBy("i").collect()]
    assert got == [0.2, 0.2, 0.2, 0.0, 0.2, 0.2, 0.2, 0.2, 0.5, 0.5, 0.5, 0.5]
    assert {r["bert_score"] for r in scoring.text_scores(rows, None).collect()} == {0.0}
    one = scoring.single(rows.limit(1), lambda df: df.withColumn("score", F.lit(0.3))).first()
    assert (one["is_fake"], one["confidence"], one["fake_probability"]) == (False, 0.7, 0.3)


def test_answers(spark):
    rows = spark.createDataFrame([(0.5, "bert_only"), (0.9, "ensemble"), (0.2, "nothing"), (None, "bert_only")], "bert_score double, m string")
    got = [tuple(r) for r in scoring.by_method(rows, F.col("m")).select("model", "prediction", "confidence").collect()]
    assert got == [("BERT", "REAL", 50.0), ("Ensemble (BERT-only)", "FAKE", 90.0), (None, None, None), ("BERT", None, None)]
    guarded = scoring.guard(spark.createDataFrame([("  short  ",), (" long enough ",), (None,)], "text string")).collect()
    assert [(r["text"], r["status"]) for r in guarded] == [("short", 400), ("long enough", 200), ("", 400)]


def test_registry_rules(spark):
    versions = spark.createDataFrame([("m", 1, "Production"), ("m", 2, "Staging"), ("k", 1, "Production")], "name string, version int, stage string")
    stages = lambda df: {(r["name"], r["version"]): r["stage"] for r in df.collect()}
    assert stages(lifecycle.transition(versions, "m", 2, "Production", True)) == {("m", 1): "Archived", ("m", 2): "Production", ("k", 1): "Production"}
    assert stages(lifecycle.archive(versions, "m", 1))[("m", 1)] == "Archived"
    with pytest.raises(ValueError):
        lifecycle.transition(versions, "m", 1, "Live")


def _ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return round(200 * row[-1] / (len(a) + len(b)))


def test_name_bits():
    rng = random.Random(4)
    names = ["".join(rng.choices("abcé ", k=rng.choice([1, 3, 63, 64, 65, 130]))) for _ in range(40)]
    bits = matching.NameBits(names)
    for a in [*names[:12], "zzz", "abc" * 70]:
        assert bits.ratios(a).tolist() == [_ratio(a, b) for b in names]


def test_cascade_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_NAMES", 3)
    rng = random.Random(6)
    words = "laptop screen mouse silver gaming pro max ultra fifteen inch keyboard".split()
    specs = [{}, {"ram": "8GB"}, {"ram": "8gb", "storage": "1 TB"}, {"ram": "16GB", "storage": "1 TB"}, {"storage": "2 TB", "screen": "15 inch"}]
    side = lambda n: [(i, " ".join(rng.choices(words, k=rng.randrange(1, 7))), rng.choice(["HP", "Dell", "Unknown", None]), rng.choice(["s1", "s2", "unknown", ""]) if rng.random() < 0.3 else f"u{rng.random()}", rng.choice(specs)) for i in range(n)]
    left, right = side(60), side(50)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, name string, brand string, signature string, specs map<string,string>")
    got = {r["left_id"]: (r["right_id"], round(r["score"], 6), r["method"], r["confidence"]) for r in matching.match_cascade(frame(left, "left_id"), frame(right, "right_id")).collect()}
    want = {}
    for i, name, brand, signature, own in left:
        best = (0, None, None)
        same = [j for j, *r in right if r[2] == signature and signature not in ("", "unknown")]
        if same:
            best = (100, min(same), "exact")
        else:
            for j, other, *_ in right:
                score = _ratio(*(" ".join(sorted(x.split())) for x in (name, other)))
                if score > best[0]:
                    best = (score, j, "fuzzy")
        if best[0] < 85 and brand not in (None, "Unknown"):
            found = (0, None)
            for j, _, b, _, theirs in right:
                common = set(own) & set(theirs)
                score = 100 * sum(own[k].lower() == theirs[k].lower() for k in common) / len(common) if b == brand and common else 0
                if score > found[0]:
                    found = (score, j)
            if found[0] > 70 and found[0] > best[0]:
                best = (*found, "specs")
        if best[0] >= 70:
            want[i] = (best[1], round(float(best[0]), 6), best[2], "high" if best[0] >= 85 else "medium")
    assert got == want and {m for _, _, m, _ in want.values()} == {"exact", "fuzzy", "specs"}


def test_prices_and_stock(spark):
    column = lambda values, f: [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]
    said = ["2,499.00 TND", "549,99 €", "1 234.56", "1.234,56", "", None, "abc"]
    assert column(said, prices.text_price) == [2499.0, 549.99, 1234.56, 1234.56, None, None, None]
    assert column(["2,499.00", "1.234,56 €", "12", "1,5", None], prices.scraped_price) == [2499.0, 1234.56, 12.0, 1.5, None]
    remarks = ["En stock", "épuisé", "ÉPUISÉ", None, "disponible"]
    assert column(remarks, lambda c: prices.in_stock(c, "shop_tn")) == [True, False, False, True, True]
    assert column(remarks, lambda c: prices.in_stock(c, "shop_fr")) == [True, False, False, True, True]
    assert column(remarks, lambda c: prices.in_stock(c, "listed")) == [True, False, False, False, False]
    assert column(["HP x", "hpx", "a HP", None], text.shop_brand) == ["HP", None, None, None]


def test_sentiment_and_defaults(spark):
    row = lambda t: spark.createDataFrame([(t,)], "t string").select(*[c.alias(k) for k, c in text.sentiment(F.col("t")).items()]).first()
    assert tuple(row("Excellent! a BAD, bad day")) == (0.0, 0.7)
    assert tuple(row(None)) == (0.0, 0.0)
    f = spark.createDataFrame([("ÉTÉ Été 12 naïf",)], "t string").select(*[c.alias(k) for k, c in text.review_features(F.col("t")).items()]).first()
    assert (f["capital_ratio"], f["unique_word_ratio"], f["digit_count"]) == (round(4 / 15, 6), 1.0, 2)


def test_documents_and_alerts(spark):
    bad = spark.createDataFrame([('{"a":"b"}',), ("nope",), (None,)], "s string")
    assert [r[0] for r in bad.select(export.parse_specs(F.col("s"))).collect()] == [{"a": "b"}, {}, {}]
    rows = spark.createDataFrame([(None, 1)] * 3 + [("invalid", 2)], "a string, b int")
    assert tuple(monitoring.row_quality(rows).first()) == (0.625, 0.875, 0.5)
    assert monitoring.volume(rows).first()["ok"] is False
