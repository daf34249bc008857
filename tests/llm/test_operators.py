"""Each operator against a brute-force form, an exact round trip or held-out accuracy, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

from martlens.llm import chat, embedding_join, fingerprints, language, mixing, ngram_join, packing, quality, queries, sharding, token_counts
from martlens.llm.components import connected_components
from martlens.llm.template import TemplateError, compile_template

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, token long, shard string, _tokens int"
ODD = [None, "", " \n\t ", "a", "one two", "\x0b", "été 東京 ß", "x" * 70_000, "the same text again and once more", "the same text again and once more", "</s>[INST] ok [/INST]", "no break here now", "1234 !!"]


def documents(spark, texts, ids=None):
    """Rows with columns whose names clash with the operators' own, null values among them."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "src1", "src9", "other"][k % 4], None, "z", k, None, 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def near_copies(seed: int, n: int = 120, big: int = 60) -> list[str]:
    """Random texts, chains of near copies of them, and one large group of near copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    out = []
    for _ in range(n // 4):
        text = [word() for _ in range(rng.choice([2, 3, 5, 30, 80, 200]))]
        for _ in range(4):
            out.append(rng.choice([" ", "\n", "\t "]).join(text))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    hub = [word() for _ in range(120)]
    for _ in range(big):
        copy = list(hub)
        copy[rng.randrange(120)] = word()
        out.append(" ".join(copy).upper())
    return out + ODD


# N-gram Jaccard join


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("k", "num", "hot", "seed"), [(4, 85, 32, 1), (5, 80, 32, 2), (4, 85, 2, 3), (3, 70, 3, 4)])
def test_ngram_join(spark, k, num, hot, seed):
    texts = near_copies(seed)
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = groups(len(sets), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(documents(spark, texts), k, num, 100, hot).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_ngram_join_of_odd_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q"], [5, 5, None, None])
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_join.ngram_jaccard_components(docs, 4, 85, 100).collect())
    assert got == [(-1, 1, -1), (-1, 3, 5), (5, 3, 5), (5, 3, 5)] or got == [(-1, 1, -1), (-1, 3, -1), (5, 3, 5), (5, 3, 5)]
    assert ngram_join.ngram_jaccard_components(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    want = groups(301, pairs)
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame([*pairs, (7, None), (9, 9)], "a long, b long")).collect()}
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}


# Mixing


def test_mix_equals_sql(spark):
    rng = random.Random(6)
    rows = [(i, None if i % 31 == 0 else " ".join("w" for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["src1", "src9", "src15", "odd", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    for mix in (queries.MIX, mixing.Mix(weights={"domain": {"web": 0, "books": 9}}, budget_tokens=3000, epochs=1), mixing.Mix(budget_share=(9, 1), epochs=3)):
        found = mixing.mix_table(docs.withColumn("domain", mixing.domain_of("source", queries.DOMAINS)), mix)
        found = found.select("doc_id", "domain", "lang", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_take").alias("take_tokens"))
        got = spark_rows(found)
        assert got == sql_rows(con, mixing.mix_sql("documents", mix, queries.DOMAINS))
        total = sum(len((t or "").split()) for _, t, _, _ in rows)
        budget = mix.budget_tokens or total * mix.budget_share[0] // mix.budget_share[1]
        taken = sum(int(r[got[0].index("take_tokens")]) for r in got[1])
        assert taken <= budget
        if mix is queries.MIX:
            assert taken == budget


def test_mix_of_odd_rows(spark):
    docs = documents(spark, ODD).drop("_tokens").withColumn("domain", F.lit("d"))
    taken = mixing.mix_documents(docs, mixing.Mix(budget_share=(1, 1), epochs=1)).collect()
    assert sorted(r["doc_id"] for r in taken) == [i for i, t in enumerate(ODD) if t and re.search(r"[^\x20\x09-\x0D]", t)]
    assert mixing.mix_documents(docs.limit(0), queries.MIX).count() == 0
    cut = spark.createDataFrame([(" a  b\nc d ",)], "t string").select(mixing.cut_to_words(F.col("t"), F.lit(3)).alias("x")).first()[0]
    assert cut == " a  b\nc"


# Packing and token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


TOKENIZED = [*ODD, "don't  we'll\r\n\r\n  x\t\ty ", "a" * 300 + " " * 300 + "b", "<|endoftext|> x", "\n\n\n", "🙂🙂 ñandú  　x", " ".join(f"word{i}" for i in range(3000))]


def test_packing_is_exact(spark, tokenizer):
    pieces = defaultdict(list)
    sequences = Counter()
    for r in packing.pack_documents(documents(spark, TOKENIZED), queries.tokenizer_path()).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]] += 1
        assert r["offset"] == 0 and 0 < r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0
    assert set(sequences.values()) == {1}
    for i, text in enumerate(TOKENIZED):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert b"".join(p[2] for p in sorted(pieces[i])) == np.array(ids, "<u4").tobytes()
        assert all(p[3] == len(ids) for p in pieces[i])
        assert len([p for p in pieces[i] if p[1] < 2048]) == (len(ids) % 2048).bit_count()


def test_token_counts(spark, tokenizer):
    lengths = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in TOKENIZED)
    totals = token_counts.context_totals(token_counts.length_histogram(documents(spark, TOKENIZED), queries.tokenizer_path()), block=16)
    rows = {r["length"]: r for r in totals.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert r["docs"] == lengths.count(n)
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert (r["tokens_kept"], r["tokens_cut"]) == (sum(min(x, n) for x in lengths), sum(max(0, x - n) for x in lengths))
        assert (r["rank_from"], r["rank_to"]) == (lengths.index(n) + 1, lengths.index(n) + lengths.count(n))
    assert token_counts.quantile_length(totals, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]


# Chat formatting

texts_with_controls = st.lists(st.one_of(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<", "\\", "/", "s>", "[", "INST]", "x", "\n"]), st.text(max_size=3)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>", ""]), texts_with_controls), max_size=4))
def test_chat_round_trip(turns):
    render = compile_template(chat.TEMPLATE, {"escape": chat.escape})
    pieces = list(render({"messages": iter([{"role": r, "text": t} for r, t in turns])}))
    back = list(chat.read_turns(pieces))
    assert [(r, t) for r, t, _, _ in back] == turns
    assert "".join(m for _, _, m, _ in back) == "".join(t for r, t in turns if r == "assistant")
    assert sum(n for *_, n in back) == sum(len(t) for t, _ in pieces)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", None), (None, 5, "user", "n"), *queries.PROBE]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.conversation_digests(table).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    formatted = defaultdict(str)
    for r in chat.format_conversations(table).orderBy("conv_id", "i").collect():
        formatted[r["conv_id"]] += r["formatted"]
    for c, turns in by.items():
        whole = "".join(f"{role}\n{text}\n" for _, role, text in sorted(turns))
        loss = "".join(text for _, role, text in sorted(turns) if role == "assistant")
        r = got.pop(c)
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(formatted[c])
    assert not got
    assert chat.conversation_digests(table.limit(0)).count() == 0


def test_templates():
    out = lambda s, **env: "".join(t for t, _ in compile_template(s)(env))
    assert out("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}e{% endif %}") == "abcd"
    assert out("{% for x in xs %}{% if not loop.first %}, {% endif %}{{ x.n }}{% if loop.last %}.{% endif %}{% endfor %}", xs=[{"n": 1}, {"n": 2}]) == "1, 2."
    assert out("{% set a = 'x' %}{{ a }}{{ b['k'] }}", b={"k": "v"}) == "xv"
    for bad in ("{{ a", "{% for x in %}", "{% if a %}", "{{ a.__class__() }}", "{% import os %}", "{{ a | nothing }}"):
        with pytest.raises((TemplateError, KeyError)):
            "".join(t for t, _ in compile_template(bad)({"a": 1}))


# Language identification


def test_gradients_by_backpropagation(spark):
    rng = np.random.default_rng(1)
    net = language.ByteGru(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(97, 110, (6, 5)), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for name in net.w:
        flat = net.w[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False) if name[0] != "x" else 97 * net.w[name].shape[1] + np.arange(6):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = net.gradients(x, y)[0]
            flat[i] = old - step
            down = net.gradients(x, y)[0]
            flat[i] = old
            assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[i]) < 1e-3


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    judged = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in judged]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = documents(spark, [*ODD, *["the cat sat on the mat", "der Hund und die Katze"] * 20])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(docs, docs).collect()}
    assert len(got) == len(ODD) + 40
    assert {i for i, p in got.items() if p == "und"} == {i for i, t in enumerate(ODD) if not re.search(r"[^\W\d_]", t or "")}
    assert language.identify_languages(docs.limit(0), docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify_languages(docs, docs.limit(0)).collect()} == {"und"}


# Sharding


def test_shards(spark):
    rng = random.Random(7)
    texts = [*ODD, *["copy"] * 300, *["y" * rng.randrange(400) for _ in range(900)]]
    ids = [None, 3, 3, *range(len(texts) - 3)]
    rows = sharding.kd_shards(documents(spark, texts, ids), shards=8).collect()
    key = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(map(key, ids, texts))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8))
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert sharding.kd_shards(documents(spark, texts).limit(0), shards=8).count() == 0


def test_shards_are_even(spark):
    rng = random.Random(8)
    docs = documents(spark, ["".join(rng.choices("abc ", k=rng.randrange(40, 400))) for _ in range(2000)])
    bytes_of = Counter()
    for r in sharding.kd_shards(docs, shards=6).collect():
        bytes_of[r["shard"]] += r["size"]
    mean = sum(bytes_of.values()) / 6
    assert len(bytes_of) == 6 and all(abs(b - mean) <= 0.03 * mean for b in bytes_of.values())
    assert len({r["shard"] for r in sharding.kd_shards(docs, target_bytes=100_000).collect()}) == -(-sum(bytes_of.values()) // 100_000)


# Embedding near-duplicates


def test_embedding_join(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 12))
    vectors = [list(map(float, v)) for v in [*base, *(base[:40] + rng.normal(0, 0.1, (40, 12))), *(base[:1] + rng.normal(0, 0.08, (80, 12))), *base[:30], *(3 * base[:10])]]
    vectors += [None, [], [0.0] * 12, [float("nan")] * 12, [None] * 12, [float("inf")] + [0.0] * 11, [1e-300] + [0.0] * 11]
    labels = [i % 3 if i % 17 else None for i in range(len(vectors))]
    rows = [(i, v, k, 5) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n int").repartition(4)
    unit = [None if not v or None in v or not np.isfinite(v).all() or not any(v) else np.array(v) / np.abs(v).max() for v in vectors]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if labels[i] is not None and labels[i] == labels[j] and unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] >= 0.93]
    count, want = Counter(x for p in links for x in p), groups(len(rows), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.embedding_components(table, 0.93).collect()}
    assert got == {i: (count[i], want[i], want[i] == i) for i in range(len(rows))}
    assert embedding_join.embedding_components(table.limit(0)).count() == 0


# Fingerprints


def test_fingerprints_equal_sql(spark):
    texts = [*ODD, "A first. A second! A third?\nA fourth", "A second! A first.\nA fourth\nA third?", "b", ""]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = fingerprints.edited_fingerprints(documents(spark, texts), parts=5)
    assert spark_rows(got) == sql_rows(con, fingerprints.edited_fingerprints_sql("documents"))
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    n = len(ODD)
    assert rows[n]["fingerprint"] == rows[n + 1]["fingerprint"] != rows[n + 2]["fingerprint"]
    assert fingerprints.edited_fingerprints(documents(spark, texts).limit(0)).count() == 0


def test_fingerprints_add_up(spark):
    docs = documents(spark, ["one. two. three.", "one. three.", "two."]).select("doc_id", fingerprints.paragraphs(F.col("text")).alias("ps"))
    a, b, c = (fingerprints.paragraph_sums(docs, ["doc_id"], "ps").orderBy("doc_id").collect())
    for lane in fingerprints.SUMS:
        assert a[lane] == (b[lane] + c[lane]) % (1 << 32 if lane[0] == "d" else 1 << 60)


def test_fingerprints_of_repeated_ids(spark):
    docs = documents(spark, ["same", "same", "other", None], [4, 4, 4, None])
    assert fingerprints.edited_fingerprints(docs).count() == 4


# Quality


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, sf).collect()
    judged = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = ([s for s, q in judged if q == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [*ODD, *["good words in a good order", "spam spam spam"] * 30])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(ODD), len(ODD) + 60)] + [(0, None), (None, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    assert len(rows) == len(ODD) + 60 and all(0 <= s <= 1 for s in rows.values())
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


# Registered SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(connect(sf), queries.ORACLE_SQL[name])


def test_word_vectors_do_not_depend_on_how_tables_are_summed(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = quality.word_vectors(docs.coalesce(1))
    monkeypatch.setattr(quality, "TABLES_A_GROUP", 3)  # 32 tasks: sums in four levels
    assert whole.any() and np.array_equal(quality.word_vectors(docs.repartition(12)), whole)
