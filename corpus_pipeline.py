"""A training-data pipeline over ``documents``: quality, language, near duplicates, source mix, packing.

Every stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept, and takes each row's own text. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import bounded_batches, cut, free_name, held_out, row_keys, table
from martlens.llm.language import least_scores, predict_language, train_language_model
from martlens.llm.mixing import cut_to_words, domain_of, mix_documents
from martlens.llm.ngram_join import row_components
from martlens.llm.packing import pack_documents
from martlens.llm.quality import quality_score, train_quality_model
from martlens.llm.queries import DOMAINS, MIX, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of quality 1 is at least 0.3; labels are those of rows that are not held out.

    Null and empty texts have a score like others; without labels all stay; columns of any name stay as they are.
    """
    bounded_batches(spark)
    model = train_quality_model(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out()))
    score = free_name(docs, "score")
    return docs.withColumn(score, quality_score(docs, model)).where(F.col(score) >= 0.3).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the predicted language as their lang, by which the mix weighs them.

    Those go that have no text or letters, or whose score is under the least of labelled texts in the predicted language.
    The network and the least scores are learned from all labelled texts that are not held out.
    All stay, with their own lang, if no labelled text is there to learn from. Other columns stay as they are.
    """
    bounded_batches(spark)
    model = train_language_model(docs.where(~held_out()))
    if model is None:
        return docs
    found = free_name(docs, "found")
    scored = cut(docs.withColumn(found, predict_language(docs, model)))  # the network runs once over each text
    least = least_scores(scored.where(~held_out()).where(F.col("lang") == F.col(f"{found}.lang")).select("lang", F.col(f"{found}.score").alias("score")))
    lang, score = F.col(f"{found}.lang"), F.col(f"{found}.score")
    enough = F.lit(True)
    for name, s in least.items():
        enough = F.when(lang == name, score >= s).otherwise(enough)
    kept = scored.where(lang != "und").where(enough)
    return kept.withColumn("lang", lang).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at a Jaccard similarity of 0.8 over 5-word shingles: that of the smallest id.

    Rows are told apart even where they share an id or have none: no text goes without a copy that stays. An id comes
    before none; of rows that repeat an id one stays.
    """
    bounded_batches(spark)
    rows, key = row_keys(docs)
    found = row_components(rows.select(F.col(key).cast("long").alias("doc_id"), "text"), k=5, num=80, den=100)
    if key == "doc_id":
        return docs.join(found.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("own")).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = F.min(F.struct(F.col("own").isNull().alias("lacks"), "own", "row"))
    stays = ids.groupBy("component_id").agg(first.alias("m")).select(F.col("m.row").alias(key))
    return rows.join(stays, key, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix, one row for each epoch; the last of a leaf is cut to its words in the budget.

    A row's columns, n_chars of a cut text apart, come back as they were, whatever their names. Texts without words are
    never taken.
    """
    rows = docs.select("doc_id", "text", domain_of("source", DOMAINS).alias("domain"), "lang", "source", F.struct(*docs.columns).alias("row"))
    taken = mix_documents(rows, MIX)
    part = F.col("_take") < F.col("_tokens")
    text = F.when(part, cut_to_words(F.col("text"), F.col("_take"))).otherwise(F.col("text"))
    taken = taken.select("row", part.alias("part"), text.alias("text"))
    value = {"text": F.col("text"), "n_chars": F.when(F.col("part"), F.char_length("text").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return taken.select(*[value.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents whose lengths are powers of two."""
    bounded_batches(spark)
    pieces = pack_documents(docs, tokenizer_path(), added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("language id", language), ("n-gram jaccard join", near_duplicates), ("source mix", mix), ("packing", packing)]

#: Trained models and tokenizers cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is cut from its lineage before the next one reads it again and again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
