"""Ids of texts that hold the tokenizer's added tokens, against the tokenizers package as it reads the file."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from martlens.llm import queries, tokens

TEXTS = [None, "", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x\n", "no  <|endoftext|>\n\n é　<|endoftext|>", "<|endoftext", "plain text", "word " * 900 + "<|endoftext|>" + " end" * 900]


@pytest.fixture(scope="module")
def want():
    from tokenizers import Tokenizer

    oracle = Tokenizer.from_file(queries.tokenizer_path())
    return [oracle.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("added"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_ids_of_slices(want):
    import pyarrow as pa

    for texts in (TEXTS, *([t] for t in TEXTS)):
        found = [ids[a:b].tolist() for _, _, ids, edges in tokens.encode_slices(pa.array(texts, pa.string()), queries.tokenizer_path(), True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert found == (want if texts is TEXTS else [want[TEXTS.index(texts[0])]])


@pytest.mark.parametrize("stage", ["op3_packing", "pipeline"])
def test_packed_ids(spark, folder, want, stage):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = queries.op3_packing(spark, folder) if stage == "op3_packing" else corpus_pipeline.packing(spark, docs, folder)
    pieces = defaultdict(list)
    for r in rows.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, ids in enumerate(want):
        ids = np.array([*ids, 1], "<u4")
        assert sum(p[1] for p in pieces[i]) == len(ids)
        assert all(n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes()) for start, length, crc, n in pieces[i])


def test_counted_lengths(spark, folder, want):
    lengths = [len(ids) for ids in want]
    assert {r["length"]: r["docs"] for r in queries.op6_token_counts(spark, folder).collect()} == {n: lengths.count(n) for n in lengths}
