"""The distributed k-d tree against a plain one that sorts all keys of a node."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
import xxhash

from martlens.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string"


def points(spark, rows):
    """(coordinates, crc32, low bits of the id's hash, size) of every row; copies have their text's least source and language."""
    order = lambda v: (v is not None, v or "")
    copies = defaultdict(list)
    for _, text, lang, source in rows:
        copies[text or ""].append((source, lang))
    least = {t: min(c, key=lambda x: (order(x[0]), order(x[1]))) for t, c in copies.items()}
    size = [len((t or "").encode()) + 1 for _, t, *_ in rows]
    given = [(s, least[t or ""][1], least[t or ""][0]) for s, (_, t, *_) in zip(size, rows)]
    dims = sharding.metadata_dimensions()
    distinct = sorted(set(given), key=str)
    found = spark.createDataFrame(distinct, "size long, lang string, source string").coalesce(1).select("size", "lang", "source", *[c.alias(n) for n, c in dims.items()])
    place = {(r["size"], r["lang"], r["source"]): tuple(r[n] for n in dims) for r in found.collect()}
    bits = lambda i: (42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)) & 0x7FFF
    return [(place[g], zlib.crc32((t or "").encode()), bits(i), s) for g, s, (i, t, *_) in zip(given, size, rows)]


def tree(pts, members, k, first, out):
    if k == 1 or not members:
        out.update(dict.fromkeys(members, first))
        return
    axis = max(range(3), key=lambda a: max(pts[m][0][a] for m in members) - min(pts[m][0][a] for m in members))
    key = {m: (pts[m][0][axis], pts[m][1], pts[m][2]) for m in members}
    total = sum(pts[m][3] for m in members)
    want, snap = total * (k // 2) / k, sharding.SNAP * total / k
    for part in (lambda x: x[:2], lambda x: x):  # beside a group of equal texts, else beside a row
        weight = defaultdict(int)
        for m in members:
            weight[part(key[m])] += pts[m][3]
        upto = 0
        for g in sorted(weight):
            if upto + weight[g] >= want:
                break
            upto += weight[g]
        below, above = want - upto, weight[g] - (want - upto)
        if len(g) == 3 or min(below, above) <= snap:
            break
    left = [m for m in members if part(key[m]) < g or (part(key[m]) == g and below > above)]
    chosen = set(left)
    tree(pts, left, k // 2, first, out)
    tree(pts, [m for m in members if m not in chosen], k - k // 2, first + k // 2, out)


@pytest.mark.parametrize(("shards", "broadcast"), [(8, 1 << 16), (7, 0)])
def test_same_shards_as_a_plain_tree(spark, monkeypatch, shards, broadcast):
    monkeypatch.setattr(sharding, "MOST_BROADCAST", broadcast)
    rng = random.Random(shards)
    texts = [None, "", "é" * 30, *["".join(rng.choices("abc ", k=rng.randrange(1, 500))) for _ in range(150)]]
    rows = [(rng.choice([i, i, i, 3, None]), rng.choice([texts[3], *texts]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for i in range(400)]
    want = {}
    tree(points(spark, rows), list(range(len(rows))), shards, 0, want)
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=shards).collect()
    line = lambda i, text, shard: (str(i), zlib.crc32((text or "").encode()), shard)
    assert sorted((str(r["doc_id"]), r["text_crc32"], r["shard"]) for r in got) == sorted(line(rows[m][0], rows[m][1], s) for m, s in want.items())
    assert len(set(want.values())) == shards


def test_slots_of_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 500)
    docs = spark.range(14_000).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "IF(id % 2 = 0, NULL, CAST(id AS STRING)) AS text", "'en' AS lang", "'s' AS source")
    rows = sharding.kd_shards(docs, shards=1).collect()
    assert sorted(r["slot"] for r in rows) == list(range(14_000)) and sum(r["doc_id"] is None for r in rows) == 7_000
