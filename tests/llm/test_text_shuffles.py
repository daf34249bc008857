"""What the n-gram join shuffles of texts that are like no other."""

from __future__ import annotations

import random

from martlens.llm import ngram_join


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lone_texts_are_shuffled_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    words = [[word() for _ in range(120)] for _ in range(600)]
    words[1] = [*words[0][:-1], "end"]  # one pair; of the hot list's 50, all are alike
    common = [word() for _ in range(120)]
    words[2:52] = [[*common[:-1], f"end{i}"] for i in range(50)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, threshold = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r["doc_id"]: r["component_id"] for r in ngram_join.row_components(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {i: 0 if i < 2 else 2 if i < 52 else i for i in range(600)}
    # random letters shrink little: once whole, and less for prefixes and the 52
    assert shuffled(spark) - before < 2 * sum(len(t) for _, t in rows)
