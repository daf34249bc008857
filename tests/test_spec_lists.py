"""Same-brand specifications by lists of equal values, against all pairs, with hot brands and values."""

from __future__ import annotations

import random

from martlens.operators import matching

LEFT, RIGHT = (f"{k} long, brand string, specs map<string,string>" for k in ("left_id", "right_id"))


def plain(left, right):
    out = {}
    for i, brand, own in left:
        best = (70.0, None)
        for j, other, theirs in right:
            if brand in (None, "", "Unknown") or brand != other or own is None or theirs is None:
                continue
            common = set(own) & set(theirs)
            same = sum(own[k] is not None and theirs[k] is not None and own[k].lower() == theirs[k].lower() for k in common)
            score = same / len(common) * 100 if common else 0.0
            if score > best[0] or (score == best[0] and best[1] is not None and j < best[1]):
                best = (score, j)
        if best[1] is not None:
            out[i] = best[::-1]
    return out


def sides(rng, n, brands, values):
    keys = ["processor", "ram", "storage", "screen", "gpu"]
    specs = lambda: None if rng.random() < 0.03 else {k: rng.choice([*values, None]) for k in rng.sample(keys, rng.randrange(0, 6))}
    return [(i, rng.choice(brands), specs()) for i in range(n)]


def test_lists_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "LIST_ROWS", 7)
    rng = random.Random(3)
    brands = ["HP"] * 8 + ["Dell", "Unknown", "", None]
    left, right = sides(rng, 250, brands, ["a", "A", "b", "c"]), sides(rng, 250, brands, ["a", "b", "C", "d"])
    got = matching.specs_matches(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(3)).collect()
    assert {r["left_id"]: (r["right_id"], round(r["score"], 9)) for r in got} == {i: (j, round(s, 9)) for i, (j, s) in plain(left, right).items()}
    assert len(got) == len({r["left_id"] for r in got}) > 100


def test_one_brand_with_very_many_specifications(spark):
    """10^5 specifications on each side of one brand, a hot value among them: bounded lists, the planted partner is found."""
    specs = "map('processor', concat('p', id), 'ram', if(id % 50 = 0, 'hot', concat('r', id % 40009)), 'storage', concat('s', id % 50021), 'screen', concat('z', id % 60013))"
    left = spark.range(100_000).selectExpr("id as left_id", "'HP' as brand", f"{specs} as specs")
    right = spark.range(100_000).selectExpr("id + 1000000 as right_id", "'HP' as brand", f"{specs.replace('processor', 'gpu')} as specs")
    got = matching.specs_matches(left, right)
    assert got.count() == 100_000
    assert got.where("left_id + 1000000 <> right_id and score <> 100").count() == 0


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "HP", {"ram": "8"})], LEFT), spark.createDataFrame([(1, "HP", {"ram": "8"})], RIGHT)
    assert matching.specs_matches(left.limit(0), right).collect() == [] == matching.specs_matches(left, right.limit(0)).collect()
    assert [tuple(r) for r in matching.specs_matches(left, right).collect()] == [(1, 1, 100.0)]
