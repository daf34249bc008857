"""The near-duplicate stage of the pipeline against brute force."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from martlens.llm import ngram_join, shingles


@pytest.mark.parametrize("k", [1, 4, 5])
def test_slices_of_few_words(k):
    """Texts alone in their slice have the same sets as among others, however few words they have."""
    texts = [None, " ", *(" ".join("abcdef"[:n]) for n in range(7))]
    together = [s.tolist() for s in shingles.shingle_sets(pa.array([*texts, "g h i j k l m"]), k)][:-1]
    assert [next(shingles.shingle_sets(pa.array([t], pa.string()), k)).tolist() for t in texts] == together
    assert [len(s) for s in together] == [max(len((t or "").split()) - k + 1, bool((t or "").split())) for t in texts]


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", *(" ".join("abcdef"[:n]) for n in range(1, 7)), "a b c"]
    for _ in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 60, 150]))]
        for _ in range(3):
            texts.append(" ".join(words))
            words = [*words]
            words[rng.randrange(len(words))] = "new"
    sets = [_sets(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a & b and 100 * len(a & b) >= 80 * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


A, B, C = ("the first text of some words that has copies", "another text of some words that has copies too", "a third text that stands alone in all tables")


def test_rows_of_one_id_are_told_apart(spark):
    """A row goes only if a copy of its own text stays, whatever ids the rows have."""
    rows = [(5, A), (5, B), (3, B), (3, B), (None, A), (None, C), (None, C), (None, None), (7, ""), (7, C + " and more words that make it another text than the one before it")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row_key int").repartition(4)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, A), (3, B), (None, C), (None, None), (7, ""), rows[-1]], key=str)


def test_very_many_rows_without_id(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", f"if(id % 3 = 0, '{A}', concat('own text number ', id, ' of rows without any id at all')) as text")
    kept = [r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) == 2001


def test_components_of_repeated_and_missing_ids(spark):
    rows = [(5, A), (5, B), (3, B), (None, A), (None, C), (None, C), (9, None)]
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100).collect()
    want = [(5, 5, 5), (5, 5, 3), (3, 5, 3), (None, 5, 5), (None, 5, None), (None, 5, None), (9, 0, 9)]
    shape = lambda rs: sorted((str(r[0]), str(r[2])) for r in rs)
    assert shape(got) == shape(want)
