"""Where the copies of a text go, against the rows themselves."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from martlens.llm import packing, queries, sharding


def placed(spark, rows, shards=8):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, text_key string, again boolean, m int").repartition(5)
    return docs, {r["doc_id"]: r for r in sharding.kd_shards(docs, shards=shards).collect()}


def test_copies_of_other_sources_and_languages_stay_together(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        text = rng.choice([None, "", "x" * rng.randrange(900), "".join(rng.choices("abcd ", k=rng.randrange(20, 3000)))])
        for _ in range(rng.choice([1, 1, 1, 2, 5, 9])):
            rows.append((len(rows), text, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src3", None]), "clash", None, 4))
    docs, got = placed(spark, rows)
    assert len(got) == len(rows)
    weight, where = Counter(), defaultdict(set)
    for i, text, *_ in rows:
        weight[text or ""] += got[i]["size"]
        where[text or ""].add(got[i]["shard"])
    slack = 2 * sharding.SNAP * sum(weight.values()) / 8
    parted = [t for t, s in where.items() if len(s) > 1]
    assert all(weight[t] > slack for t in parted)
    assert len(parted) <= 7 and sum(weight[t] <= slack for t in where) > 100
    by = Counter()
    for r in got.values():
        by[r["shard"]] += r["size"]
    most = max(len(t) for t in where) + 1
    assert max(by.values()) - min(by.values()) <= 2 * (1.75 * slack / 2 + most)


def test_a_group_of_a_third_of_all_rows_is_spread(spark):
    rng = random.Random(4)
    rows = [(i, "hot text" if i % 3 == 0 else "".join(rng.choices("abc ", k=rng.randrange(2, 14))), rng.choice(["en", "de"]), f"src{i % 7}", None, True, 0) for i in range(3000)]
    _, got = placed(spark, rows)
    by = Counter()
    for r in got.values():
        by[r["shard"]] += r["size"]
    assert len(by) == 8 and max(by.values()) < 1.04 * sum(by.values()) / 8
    assert all(sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values()))) for s in by)


def test_no_group_is_parted_in_the_query(spark):
    sf = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    where, weight, total = defaultdict(set), Counter(), 0
    for r in queries.op7_sharding(spark, sf).collect():
        where[text[r["doc_id"]]].add(r["shard"])
        weight[text[r["doc_id"]]] += r["size"]
        total += r["size"]
    assert all(weight[t] > 2 * sharding.SNAP * total / 8 for t, s in where.items() if len(s) > 1)


def test_bucket_report(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, None), (2, "")], "doc_id long, text string")
    pieces = packing.pack_documents(docs, queries.tokenizer_path(), window=4)
    rows = pieces.collect()
    want = Counter(r["length"] for r in rows)
    got = {r["bucket"]: (r["sequences"], r["tokens"]) for r in packing.bucket_report(pieces).collect()}
    assert got == {b: (n, b * n) for b, n in want.items()} and set(got) <= {1, 2, 4}
    assert sorted(r["doc_tokens"] for r in rows if r["doc_id"] is None or r["doc_id"] == 2) == [1, 1]
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path()).count() == 0
