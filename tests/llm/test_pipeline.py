"""Every stage of the pipeline on odd rows and clashing names, and the whole against a plain recomputation."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martlens.llm import mixing, queries

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, domain string, _tokens double, _take int, _score string, score int, found string, row string, part int, _row long, component_id long, ids string, length int"
LONG = " ".join(f"long{i % 700}" for i in range(30_000))


def odd_documents(spark):
    rng = random.Random(2)
    word = {"en": "the cat sat on a mat and ran over hills".split(), "de": "der Hund lief über die Wiese und bellte laut".split()}
    texts = [(None, None), ("", "en"), (" \n", None), ("x", "de"), ("12 !!", "en"), ("été 東京 ß", None), (LONG, "en"), (LONG, "en")]
    for i in range(60):
        lang = "en" if i % 2 else "de"
        texts.append((" ".join(rng.choices(word[lang], k=rng.randrange(8, 60))), lang))
    ids = [*range(len(texts)), 20, 20, None]
    texts += [texts[20], ("another text under an id that is there", "en"), ("a text without an id", "en")]
    rows = [(i, t, lang, rng.choice(["src1", "src9", "odd", None]), None if t is None else len(t), "mine", 7.5, 3, "s", 4, "f", "r", 1, None, 9, "i", 2) for i, (t, lang) in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = odd_documents(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1 if i > 1 else 0) for i in range(68)] + [(1, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def plain_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_rows_as_they_are(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0
    out = stage(spark, docs, folder)
    if name == "packing":
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes == empty.dtypes
    before, after = plain_rows(docs), plain_rows(out)
    if name == "language id":  # the prediction is the language
        at = docs.columns.index("lang")
        without = lambda rows: Counter({r: n for key in [Counter()] for r, n in sum((Counter({x[:at] + x[at + 1 :]: k}) for x, k in rows.items()), key).items()})
        assert not without(after) - without(before)
        assert {r[at] for r in after} <= {"en", "de"}
        assert not any(r[1] is None or not re.search(r"[^\W\d_]", r[1]) for r in after)
    elif name == "source mix":
        text, n = docs.columns.index("text"), docs.columns.index("n_chars")
        rest = lambda r: tuple(v for i, v in enumerate(r) if i not in (text, n))
        known = defaultdict(list)
        for r in before:
            known[rest(r)].append(r[text])
        for r in after:
            assert any(t and t.startswith(r[text]) and re.search(r"\S", r[text]) for t in known[rest(r)])
            assert r[n] == len(r[text])
    else:
        assert not after - before
    assert sum(after.values()) > 0


def test_quality_rejects(spark, folder):
    """Labels 0 of planted junk are learned, and junk goes."""
    rng = random.Random(5)
    good = [" ".join(rng.choices("we went to see the old house by the river and it was warm".split(), k=40)) for _ in range(120)]
    junk = ["$$$ %%% buy### " * 12 + str(i) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)], "doc_id long, text string")
    path = f"{folder}/junk"
    spark.createDataFrame([(i, int(i < 120)) for i in range(240) if i % 3], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, path).collect()}
    assert len([i for i in kept if i < 120]) >= 118 and len([i for i in kept if i >= 120]) <= 2


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_whole_pipeline(spark):
    """run() on the smallest tables: each stage's decision recomputed plainly from what the stage before it kept."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, inputs = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, sf))
        inputs.append([r.asDict() for r in kept.collect()])
    first = {r["doc_id"]: r.asDict() for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in queries.op10_quality(spark, sf).collect()}
    assert sorted(r["doc_id"] for r in inputs[0]) == sorted(i for i, p in scores.items() if p == 1)
    assert all(r == first[r["doc_id"]] for r in inputs[0])
    assert {r["doc_id"] for r in inputs[1]} <= {r["doc_id"] for r in inputs[0]} and len(inputs[1]) >= 0.95 * len(inputs[0])
    assert np.mean([r["lang"] == first[r["doc_id"]]["lang"] for r in inputs[1]]) > 0.95
    # near duplicates
    texts = {r["doc_id"]: shingles(r["text"]) for r in inputs[1]}
    ids, root = sorted(texts), {i: i for i in texts}
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b]) > 0:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    assert sorted(r["doc_id"] for r in inputs[2]) == sorted(set(root.values()))
    # mix
    con = duckdb.connect()
    con.register("kept", pd.DataFrame(inputs[2]))
    taken = con.execute(f"SELECT doc_id, take_tokens FROM ({mixing.mix_sql('kept', queries.MIX, queries.DOMAINS)})").fetchall()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert Counter(taken) == Counter((r["doc_id"], words(r["text"])) for r in inputs[3])
    assert all(first[r["doc_id"]]["text"].startswith(r["text"]) and (r["n_chars"] == len(r["text"]) or r["text"] == first[r["doc_id"]]["text"]) for r in inputs[3])
    # packing
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in inputs[3]:
        ids, at = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4"), 0
        while at < len(ids):
            rest = len(ids) - at
            size = 2048 if rest >= 2048 else 1 << (rest.bit_length() - 1)
            want[(r["doc_id"], at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids))] += 1
            at += size
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_mixing_of_clashing_names(spark):
    docs = odd_documents(spark).withColumn("_bucket", F.lit("b")).withColumn("_full", F.lit("f")).withColumn("_key", F.lit(1))
    taken = mixing.mix_documents(docs, mixing.Mix(budget_share=(1, 1), epochs=1))
    assert set(taken.columns) == set(docs.columns) | {"_tokens", "_epoch", "_take"}
    rows = taken.collect()
    assert all((r["domain"], r["_bucket"], r["_full"], r["_key"], r["row"]) == ("mine", "b", "f", 1, "r") for r in rows)
    assert all(r["_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= r["_take"] > 0 for r in rows)
