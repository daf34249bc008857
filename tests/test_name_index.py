"""The name index against comparing all names with all."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martlens.operators import matching, name_index


def names(rng, n, words=60):
    """Product names of three to seven words with a code; some are near copies of one before."""
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 11))) for _ in range(words)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            old = rng.choice(out).split()
            old[rng.randrange(len(old))] = rng.choice([f"x{i}", rng.choice(pool)])
            out.append(" ".join(old))
        else:
            out.append(" ".join([*rng.choices(pool, k=rng.randrange(3, 8)), f"c{i}"]))
    return out


def families(rng, n):
    """Names in families of one brand and line, a family for every forty names, as products come."""
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    lines = [f"{word(6)} {word(8)} {word(7)}" for _ in range(n // 40)]
    return [f"{rng.choice(lines)} {rng.choice(['8 gb', '16 gb', '32 gb'])} {word(3)}{rng.randrange(1000)}" for _ in range(n)]


def plain(left, right, accept):
    bits, found = name_index.NameBits(right), {}
    for a in left:
        score = bits.ratios(a)
        best = int(score.argmax())
        if score[best] >= accept:
            found[a] = (best, int(score[best]))
    return found


@pytest.mark.parametrize(("n", "block"), [(300, 16), (300, 2000), (40, 3)])
def test_index_equals_all_pairs(spark, n, block):
    rng = random.Random(n + block)
    both = list(dict.fromkeys(names(rng, 2 * n) + ["a", "zz", "q" * 200]))
    rng.shuffle(both)
    left, right = both[::2] + both[1:9:2], both[1::2]
    got = name_index.best_names(spark.createDataFrame([(x,) for x in dict.fromkeys(left)], "tokens string").repartition(3), spark.createDataFrame([(x, i) for i, x in enumerate(right)], "tokens string, right_id long"), 70, block)
    assert {r["tokens"]: (r["right_id"], r["score"]) for r in got.collect()} == plain(left, right, 70)


def test_counts_bound_distances():
    rng = random.Random(3)
    some = [*names(rng, 60), "é東京", "12 34", "a" * 300]
    counts = name_index.character_counts(some)
    assert (counts.sum(1) == [len(x) for x in some]).all()
    for n, a in enumerate(some):
        bits = name_index.NameBits(some)
        assert (np.abs(counts - counts[n]).sum(1) <= bits.lengths + len(a) - 2 * bits.common(a)).all()


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "tokens string, right_id long"), spark.createDataFrame([("a b", 1)], "tokens string, right_id long")
    for left, right in ((none, some), (some, none), (none, none)):
        assert name_index.best_names(left.select("tokens"), right, 70, 8).collect() == []


def test_comparisons_grow_slower_than_the_square(spark):
    """Over three sizes: names compared by their subsequence; of the pairs of blocks, those whose boxes are too far apart do not meet."""
    sums = []
    for n in (500, 1000, 2000):
        rng = random.Random(9)
        pool = list(dict.fromkeys(" ".join(sorted(x.split())) for x in families(rng, 2 * n)))
        rng.shuffle(pool)
        left, right = (name_index.placed(spark.createDataFrame([(x, i) for i, x in enumerate(pool[k::2])], "tokens string, right_id long")) for k in (0, 1))
        tree = name_index.kd_tree(name_index._matrix(left.unionByName(right).select("at").toArrow().column("at")), (n // 16 - 1).bit_length())
        x, y = (name_index.leaves(t, tree).withColumn("need", F.lit(70)) for t in (left, right))
        at_home = x.groupBy("leaf").cogroup(name_index._again(y).groupBy("leaf")).applyInArrow(name_index._home, "tokens string, at binary, leaf int, need int, score int, right_id long").cache()
        seeded = at_home.withColumn("u", (F.col("leaf") * 4 + (F.col("score") >= 80).cast("int") + (F.col("score") >= 90).cast("int") + (F.col("score") >= 97).cast("int")).cast("int"))
        blocks = name_index.block_pairs(seeded, y, 1 << 20).count()
        found = name_index.best_of(at_home.toArrow(), y.toArrow())
        sums.append((found[2], len(pool) ** 2 // 4, blocks, seeded.select("u").distinct().count() * y.select("leaf").distinct().count()))
    (few, _, _, _), _, (many, every, met, all_blocks) = sums
    assert many < 0.02 * every and many < 8 * few and met < 0.8 * all_blocks, sums


def test_cascade_uses_the_index(spark):
    rng = random.Random(12)
    both = names(rng, 120)
    left = spark.createDataFrame([(i, x, "b", f"l{i}", {}) for i, x in enumerate(both[::2])], "left_id long, name string, brand string, signature string, specs map<string,string>")
    right = spark.createDataFrame([(i, x, "c", f"r{i}", {}) for i, x in enumerate(both[1::2])], "right_id long, name string, brand string, signature string, specs map<string,string>")
    got = {r["left_id"]: (r["right_id"], r["score"]) for r in matching.match_cascade(left, right).collect()}
    order = lambda x: " ".join(sorted(x.split()))
    want = plain([order(x) for x in both[::2]], [order(x) for x in both[1::2]], 70)
    assert got == {i: (want[order(x)][0], float(want[order(x)][1])) for i, x in enumerate(both[::2]) if order(x) in want}
