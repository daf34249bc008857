"""Importance resampling, exact duplicates and the filter audit against plain recomputations, on tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, spark_rows, sql_rows

from martlens.llm import filter_audit, importance, queries
from martlens.llm.exact_dedup import exact_duplicates

DOCS = "doc_id long, text string, lang string, source string, key long, slice binary, rank int, weight string"
LONG = "many words make a long text " * 12_000
ODD = [None, "", " \n\t ", "a", "One two", "\x0b", "été 東京 ß É", "É", "é", "x" * 70_000, "X" * 70_000, LONG, LONG + "!", LONG.upper(), "the same text", "the same text", "THE same text", "no break", "A$B", "\x00z\x7f y"]


def documents(spark, texts, ids=None):
    rows = [(i, t, [None, "en", "de", ""][k % 4], "s", k, b"z", 1, "w") for k, (i, t) in enumerate(zip(range(len(texts)) if ids is None else ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def texts(seed: int, n: int = 150) -> list[str]:
    """Random texts over few words, some equal but for case, some of one start and different ends."""
    rng = random.Random(seed)
    start = "shared start " * 60
    out = []
    for _ in range(n):
        words = [rng.choice(["Aa", "bb", "cc", "dd1", "É", "Z", "ee#", "long" * 4]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 250]))]
        text = rng.choice([" ", "\n", "-"]).join(words)
        out += [text, start + text, *([text.swapcase() if text.isascii() else text] if rng.random() < 0.3 else [])]
    return out + ODD


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op11_importance", "op12_exact_dedup", "op13_filter_audit"])
def test_equals_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(connect(sf), queries.ORACLE_SQL[name])


# Importance resampling


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = {k: grams(t) for k, (_, t) in enumerate(rows)}
    s, t = (Counter(bucket(f) for fs in side for f in fs) for side in ([g[1] for g in own.values()], [grams(x)[1] for x in target]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + 10_000)) / ((s[b] + 1) * (big_t + 10_000))))
    found = []
    for k, (doc_id, _) in enumerate(rows):
        weight = sum(gain(bucket(f)) for f in own[k][1])
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        found.append((doc_id, len(own[k][1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), own[k][0] >= 20))
    able = sorted((x for x in found if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = able[: 5 * len(able) // 100]
    return [(*x[:4], None) for x in found], [(*x[:4], i + 1) for i, x in enumerate(drawn)]


@pytest.mark.parametrize("repeats", [False, True])
def test_importance_equals_brute_force(spark, repeats):
    body = texts(5)
    rng = random.Random(1)
    ids = [rng.choice([None, 3, 4, *range(50)]) for _ in body] if repeats else list(range(len(body)))
    target = ["Aa bb cc", "é z " * 30, None, ""]
    got = [tuple(r) for r in importance.importance_resample(documents(spark, body, ids), spark.createDataFrame([(x,) for x in target], "text string")).collect()]
    every, drawn = resampled(list(zip(ids, body, strict=True)), target)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((*x[:4], None) for x in got), key=key) == sorted(every, key=key)
    assert sorted((x for x in got if x[4] is not None), key=lambda x: x[4]) == drawn and drawn


def test_importance_of_empty_tables(spark):
    empty = documents(spark, []).limit(0)
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.importance_resample(empty, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert importance.importance_resample(empty, target).collect() == []
    only = importance.importance_resample(documents(spark, ["w " * 30] * 20), target.limit(0)).collect()
    assert len({r["weight"] for r in only}) == 1 and [r["rank"] for r in only if r["rank"]] == [1]


def test_ranks_go_on_over_parts_and_ties(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as v").repartition(7)
    got = importance.with_ranks(rows, [rows["v"].desc(), rows["id"].asc()]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda i: (-(i % 3), i))
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))


# Exact duplicates


def duplicates(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    return [(d, max((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids]


@pytest.mark.parametrize(("first", "growth", "repeats"), [(64, 8, False), (64, 8, True), (1, 3, False)])
def test_exact_duplicates_equal_brute_force(spark, first, growth, repeats):
    body = texts(9, 60 if first > 1 else 12)
    rng = random.Random(2)
    ids = [rng.choice([None, 3, *range(40)]) for _ in body] if repeats else list(range(len(body)))
    got = exact_duplicates(documents(spark, body, ids), first, growth).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=key) == sorted(duplicates(list(zip(ids, body, strict=True))), key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({lower(t) for t in body}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates_of_an_empty_table(spark):
    out = exact_duplicates(documents(spark, []).limit(0))
    assert out.collect() == [] and out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_duplicates_of_rows_without_ids(spark):
    got = exact_duplicates(documents(spark, ["a", "A", None, "", LONG, LONG], [None, None, 7, None, None, None])).collect()
    assert sorted((r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == sorted([(-1, 2, True), (-1, 2, False)] * 2 + [(7, 2, True), (7, 2, False)])


# Filter audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]


def audited(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[j] == 1 and i is not None} for j in (0, 1))
    least = defaultdict(lambda: math.inf)
    for doc_id, text, _ in rows:
        least[text or ""] = min(least[text or ""], math.inf if doc_id is None else doc_id)
    known = [([*fails(t or ""), d is not None and least[t or ""] < d], p or "", d in good, d in toxic) for d, t, p in rows]
    out = {}
    for part in {x[1] for x in known}:
        share = Counter()
        for order in permutations("ABCDE"):
            left = [x for x in known if x[1] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                at = "ABCDE".index(letter)
                now = [x for x in left if x[0][at]]
                alone = sum(x[0][at] and sum(x[0]) == 1 for x in left + gone)
                redundant = sum(x[0][at] for x in gone)
                left, gone = [x for x in left if not x[0][at]], gone + now
                share[letter] += len(now)
                out[part, "".join(order), step] = [len(left), len(now), redundant, alone, sum(x[2] for x in now), sum(x[3] for x in now)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(share[key[1][key[2] - 1]])
    return out


@pytest.mark.parametrize("repeats", [False, True])
def test_audit_equals_brute_force(spark, repeats):
    body = texts(3, 40)
    rng = random.Random(4)
    ids = [rng.choice([None, 3, *range(60)]) for _ in body] if repeats else list(range(len(body)))
    docs = documents(spark, body, ids)
    labels = [(rng.choice([None, *range(80)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(90)]
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == audited(rows, labels)
    assert all(kind == "bigint" for name, kind in got.dtypes if name not in ("part", "filter_order", "step"))


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(documents(spark, []).limit(0), labels).collect() == []
    assert filter_audit.filter_audit(documents(spark, ["a", "b c"]), labels.limit(0)).count() == 2 * 600


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aA bÉ\t\n\x0b\x1c #|"), max_size=40)), max_size=12), st.integers(0, 3))
def test_scan_of_sliced_buffers(values, cut):
    array = pa.array(values, pa.string())[cut:]
    want = [sum(bool(f) << i for i, f in enumerate(fails(t or ""))) for t in values[cut:]]
    assert filter_audit.scan_texts(array).tolist() == want


def test_words_of_one_hash_are_told_apart(monkeypatch):
    real = filter_audit.word_table

    def clashing(data, bounds):
        start, length, names = real(data, bounds)
        return start, length, names % np.uint64(3)

    monkeypatch.setattr(filter_audit, "word_table", clashing)
    rng = random.Random(8)
    for n in (150, 300):
        text = " ".join(f"w{rng.randrange(n)}" for _ in range(n))
        assert filter_audit.scan_texts(pa.array([text, text + " z"])).tolist() == [sum(bool(f) << i for i, f in enumerate(fails(t))) for t in (text, text + " z")]


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 50)
    monkeypatch.setattr(filter_audit, "SLICE_BYTES", 10)
    for text in ("ab cd " * 200, "x" * 500 + " y" * 300, "É " * 250, "one" * 100, " " * 400):
        assert filter_audit.scan_texts(pa.array(["q", text, None])).tolist()[1] == sum(bool(f) << i for i, f in enumerate(fails(text)))
