"""The queries of this subpackage: one thin query for each operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .chat import conversation_digests
from .embedding_join import embedding_components, embedding_components_sql
from .exact_dedup import exact_duplicates, exact_duplicates_sql
from .filter_audit import audit_sql, filter_audit
from .fingerprints import edited_fingerprints, edited_fingerprints_sql
from .importance import importance_resample, importance_sql
from .language import identify_languages
from .mixing import Mix, domain_of, mix_sql, mix_table
from .ngram_join import ngram_jaccard_components, ngram_jaccard_sql
from .packing import pack_documents
from .quality import score_quality
from .sharding import kd_shards
from .token_counts import context_totals, length_histogram


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer file lies on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


#: Domains, and target weights at each level, of the mixing query.
DOMAINS = {"web": [f"src{i}" for i in range(7)], "reference": [f"src{i}" for i in range(7, 14)], "books": [f"src{i}" for i in range(14, 20)]}
MIX = Mix(weights={"domain": {"web": 50, "reference": 30, "books": 20}, "lang": {"en": 40, "de": 20, "es": 20, "fr": 20}})


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of("source", DOMAINS))
    return mix_table(docs, MIX).select("doc_id", "domain", "lang", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_take").alias("take_tokens"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


#: A conversation whose texts hold the control strings of the template.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs, docs.where(~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(length_histogram(table(spark, sf_dir, "documents"), tokenizer_path(), added=True))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    scores = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, least=0.3)
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_mixing,
        op3_packing,
        op4_chat_format,
        op5_language_id,
        op6_token_counts,
        op7_sharding,
        op8_embedding_join,
        op9_fingerprints,
        op10_quality,
        op11_importance,
        op12_exact_dedup,
        op13_filter_audit,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_jaccard_sql("documents", 4, 85, 100),
    "op2_mixing": mix_sql("documents", MIX, DOMAINS),
    "op8_embedding_join": embedding_components_sql("embeddings", 0.93),
    "op11_importance": importance_sql("documents", "benchmark"),
    "op12_exact_dedup": exact_duplicates_sql("documents"),
    "op13_filter_audit": audit_sql("documents", "labels"),
    "op9_fingerprints": edited_fingerprints_sql("documents"),
}
