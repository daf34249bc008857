"""Classifiers over review features, fitted by MLlib on all training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rating_features, review_features, sentiment

#: Numeric inputs of every model: the features of the text, and those of the rating.
TEXT_FEATURES = ["text_length", "word_count", "avg_word_length", "exclamation_count", "question_count", "capital_ratio", "digit_count", "unique_word_ratio", "sentence_count", "is_very_short", "is_very_long"]
FEATURES = [*TEXT_FEATURES, "sentiment_polarity", "sentiment_subjectivity", "rating", "is_extreme_rating"]

#: Estimators by name, given the number of training rows. The penalty of the regression is 1 over that number, on
#: standardized features; a forest's trees end at 15 levels, so that a level's statistics stay bounded.
ESTIMATORS: dict[str, Callable[[int], Estimator]] = {
    "logreg": lambda n: LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1), featuresCol="_features", labelCol="_label"),
    "forest": lambda n: RandomForestClassifier(numTrees=100, maxDepth=15, seed=42, featuresCol="_features", labelCol="_label"),
    "boosted": lambda n: GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.1, seed=42, featuresCol="_features", labelCol="_label"),
}


def with_features(rows: DataFrame, text: str = "text", rating: str = "rating") -> DataFrame:
    """Rows with the columns of FEATURES; a null text counts as empty, a null rating as 3."""
    return rows.withColumns(review_features(F.col(text)) | sentiment(F.col(text)) | rating_features(F.col(rating)))


def fit(rows: DataFrame, kind: str, label: str) -> PipelineModel:
    """The named model on rows with FEATURES and a label of 0 or 1; rows without a label are left out. Needs one row at least."""
    rows = rows.where(F.col(label).isNotNull()).select(*FEATURES, F.col(label).cast("double").alias("_label"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    return Pipeline(stages=[assemble, ESTIMATORS[kind](rows.count())]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with score, the probability of label 1, and predicted, 1 where it is over one half."""
    scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.withColumn("predicted", (F.col("score") > 0.5).cast("int")).drop("_features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance) of a tree model: one row for each of FEATURES, summing to 1."""
    found = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(x)) for f, x in zip(FEATURES, found)], "feature string, importance double")


def present(rows: DataFrame, names: list[str] = FEATURES) -> list[str]:
    """Those of the features that the table has, in their order."""
    return [n for n in names if n in rows.columns]


def scores_or_zero(model: PipelineModel | None, rows: DataFrame, name: str = "xgboost_score") -> DataFrame:
    """Rows with the probability of label 1, zeros if there is no model; a missing feature counts as 0."""
    if model is None:
        return rows.withColumn(name, F.lit(0.0))
    scored = predict(model, rows.fillna(0, present(rows)))
    return scored.withColumnRenamed("score", name).drop("predicted")


def load_first(spark, paths: list[str]) -> PipelineModel | None:
    """The model in the first of the folders that exists; None if none does."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return PipelineModel.load(path)
    return None


def save(model: PipelineModel, measured: DataFrame, folder: str) -> None:
    """A model and the table of its metrics under a folder."""
    model.write().overwrite().save(f"{folder}/model")
    measured.write.mode("overwrite").parquet(f"{folder}/metrics")
