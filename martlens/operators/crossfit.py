"""Scores of reviews by models that have never seen them: cross-fitting over hashed folds, and the blend of both models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from . import reviews, training

#: Buckets of the words that the text model weighs.
WORD_BUCKETS = 1 << 14


def fold_of(key: str, folds: int) -> Column:
    """A fold by the key alone, so a review is in one fold however often and in whatever order it is read; a null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the hashed words of their text as a vector, _counts; a null text counts as empty."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=WORD_BUCKETS, binary=True)
    return counts.transform(words.transform(rows.withColumn("_text", F.coalesce(text, F.lit(""))))).drop("_text", "_words")


def fit_words(rows: DataFrame, label: str) -> PipelineModel:
    """A regression over the hashed words of labelled rows, which with_words gave."""
    rows = rows.where(F.col(label).isNotNull()).select("_counts", F.col(label).cast("double").alias("_label"))
    return Pipeline(stages=[LogisticRegression(maxIter=50, regParam=0.01, featuresCol="_counts", labelCol="_label")]).fit(rows)


def score_words(model: PipelineModel | None, rows: DataFrame, name: str = "bert_score") -> DataFrame:
    """Rows with the text model's probability of label 1; zeros without a model."""
    if model is None:
        return rows.withColumn(name, F.lit(0.0))
    return model.transform(rows).withColumn(name, F.get(vector_to_array("probability"), 1)).drop("rawPrediction", "probability", "prediction")


def cross_fitted(rows: DataFrame, fit: Callable[[DataFrame], PipelineModel], score: Callable[[PipelineModel | None, DataFrame], DataFrame], label: str, fold: str, folds: int) -> DataFrame:
    """Rows with what ``score`` adds, each from the model that was fitted on the labelled rows of all other folds.

    Rows without a label are scored and never learned from. A fold whose others have no label has no model.
    """
    out = None
    for f in range(folds):
        others = rows.where((F.col(fold) != f) & F.col(label).isNotNull())
        part = score(None if others.isEmpty() else fit(others), rows.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def blended_scores(rows: DataFrame, label: str = "is_fake", key: str = "doc_id", folds: int = 3, kind: str = "forest") -> DataFrame:
    """rows (key, text, rating, label) with fold, xgboost_score (a model of features), bert_score (one of words), and the
    ensemble of both: no score comes from a model that saw the row, its copies of one key included."""
    rows = staged(with_words(training.with_features(rows.withColumn("fold", fold_of(key, folds)))))  # texts are read once
    by_features = cross_fitted(rows, lambda df: training.fit(df, kind, label), training.scores_or_zero, label, "fold", folds)
    both = cross_fitted(by_features, lambda df: fit_words(df, label), score_words, label, "fold", folds)
    return reviews.ensemble(both.drop("_counts"))
