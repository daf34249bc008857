"""Long lists of prefix shingles in the n-gram join: what is compared, and that no link is lost."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from martlens.llm import ngram_join, shingles


def brute(texts, k, num):
    sets = [set(s.tolist()) for s in shingles.shingle_sets(pa.array(texts, pa.string()), k)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a & b and 100 * len(a & b) >= num * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return dict(enumerate(root))


def test_groups_are_lists_or_their_union(spark):
    chain = [(c, 50, t) for t in range(100) for c in (t, t + 1, t + 2)]  # 100 lists of 3 over 102 classes
    copies = [(c, 50, 1000 + t) for t in range(30) for c in range(500, 540) if c % 30 != t]  # 30 lists over 40 classes
    rows = ngram_join._hot_groups(spark.createDataFrame(chain + copies, "cls long, n int, token long")).collect()
    assert sorted((r["key"], r["cls"]) for r in rows if r["by_list"]) == sorted((t, c) for c, _, t in chain)
    assert sorted((r["key"], r["cls"]) for r in rows if not r["by_list"]) == [(500, c) for c in range(500, 540)]


@pytest.mark.parametrize(("step", "length", "num"), [(6, 60, 65), (2, 60, 85), (10, 60, 80)])
def test_sliding_windows(spark, step, length, num):
    """Every text shares shingles with its neighbours only, and all are connected: lists are compared by themselves."""
    rng = random.Random(step)
    words = [f"w{rng.randrange(10_000)}" for _ in range(length + 200 * step)]
    texts = [" ".join(words[i * step : i * step + length]) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(docs, 3, num, 100, hot=2).collect()}
    assert got == brute(texts, 3, num)


def test_small_sets_and_a_common_passage(spark):
    """Sets that no other set can be like, and texts that are mostly one passage, some of them linked."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(f"s{rng.randrange(4)}" for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    for _ in range(60):
        own = [f"o{rng.randrange(9999)}" for _ in range(rng.choice([2, 5, 9, 14, 40]))]
        texts.append(" ".join(passage + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for k, num, hot in ((4, 85, 4), (1, 50, 3), (2, 70, 32)):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(docs, k, num, 100, hot=hot).collect()}
        assert got == brute(texts, k, num)


def test_sketch_counts_sets(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bits = 17
    want = np.zeros(1 << bits)
    for s in shingles.shingle_sets(pa.array(texts), 2):
        for b, n in Counter((s >> np.uint64(64 - bits)).tolist()).items():
            want[b] += n
    got = ngram_join.shingle_sketch(docs, 2, bits)
    assert np.array_equal(got, np.minimum(np.round(8 * np.log2(1 + np.maximum(want - want.mean(), 0))), 255).astype(np.uint8))
    assert ngram_join.sketch_bits(0) == 20 and ngram_join.sketch_bits(10**13) == 24
    counts = np.array([0, 1, 255, 256, 70_000, 1 << 33], np.uint64)
    assert ngram_join._unpacked(ngram_join._packed(counts)).tolist() == [0, 1, 255, 256, 70_000, (1 << 32) - 1]
