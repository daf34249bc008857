"""The language stage of the pipeline on letter noise planted among clean texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from martlens.llm import language


def test_noise_goes_and_clean_texts_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10)))
    # the noise has no label, so nothing is learned from it
    noise = [(-1 - i, " ".join(word() for _ in range(200)), None) for i in range(100)]
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = clean.unionByName(spark.createDataFrame([*noise, (-500, "12 34 !", None), (-501, None, None)], "doc_id long, text string, lang string"))
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sum(i >= 0 for i in ids) >= 0.98 * clean.count()
    assert sum(-100 <= i < 0 for i in ids) <= 5
    assert -500 not in ids and -501 not in ids


def test_all_stay_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, "").count() == 2


def test_one_language(spark):
    docs = spark.createDataFrame([(i, f"the cat number {i} sat on the mat", "en") for i in range(60)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, "").count() >= 58


def test_all_labelled_texts_count(spark):
    scored = spark.createDataFrame([("en", i / 1000) for i in range(1001)] + [("fr", 0.5)], "lang string, score double")
    assert {k: round(v, 5) for k, v in language.least_scores(scored, 0.005).items()} == {"en": 0.005, "fr": 0.5}
    known = [(i, f"the cat number {i} sat on the mat", "en") for i in range(40)] + [(100 + i, f"le chat {i} dort dans la maison", "fr") for i in range(40)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    start = language.train_language_model(docs(known), texts=4)
    other = language.train_language_model(docs([(i, t.upper() if i % 100 > 20 else t, lang) for i, t, lang in known]), texts=4)
    # the sample has a few texts of each; capital letters of others must have moved what is known of them
    moved = lambda a, b: max(abs(a.w["xf"][list(b"THECATNUMBER")] - b.w["xf"][list(b"THECATNUMBER")]).max(), 0)
    assert moved(start, other) > 0 and (language.train_language_model(docs(known), texts=4).flat() == start.flat()).all()
