"""Answers of review scoring: labels, confidence and probabilities from model scores, and the choice of a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import clean_review

#: What each method answers with: the model named in the answer. All read the text model's score, as the other model has
#: features but no text; a method that is not listed has no answer.
METHODS = {"bert_only": "BERT", "xgboost_only": "BERT", "ensemble": "Ensemble (BERT-only)"}


def answer(fake: Column) -> dict[str, Column]:
    """prediction, confidence and both probabilities in percent, from the probability of a fake; an even one is REAL."""
    real = 1 - fake
    return {
        "prediction": F.when(fake > real, "FAKE").when(fake <= real, "REAL"),
        "confidence": F.round(F.greatest(fake, real) * 100, 4),
        "probability_fake": F.round(fake * 100, 4),
        "probability_real": F.round(real * 100, 4),
    }


def by_method(rows: DataFrame, method: Column, score: str = "bert_score") -> DataFrame:
    """Rows with the answer of a method and the model that gave it; nulls for a method that is not known."""
    known = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    model = F.try_element_at(known, method)
    rows = rows.withColumn("model", model)
    return rows.withColumns({k: F.when(F.col("model").isNotNull(), c) for k, c in answer(F.col(score)).items()})


def softmax(fake: Column, real: Column) -> Column:
    """The probability of a fake from two logits, without overflow."""
    return 1 / (1 + F.exp(F.least(real - fake, F.lit(700.0))))


def guard(requests: DataFrame, text: str = "text", least: int = fixed.SHORTEST_REQUEST) -> DataFrame:
    """Requests with the trimmed text, whether it is long enough to be answered, and the status."""
    kept = F.trim(F.coalesce(F.col(text), F.lit("")))
    rows = requests.withColumn(text, kept)
    return rows.withColumn("accepted", F.char_length(text) >= least).withColumn("status", F.when(F.col("accepted"), 200).otherwise(400))


def usable(reviews: DataFrame, text: str, *needed: str) -> DataFrame:
    """Reviews with a non-blank text and no null in the other columns named."""
    return reviews.dropna(subset=[text, *needed]).where(F.trim(text) != "")


def usable_cleaned(reviews: DataFrame, text: str, *needed: str) -> DataFrame:
    """Reviews with their cleaned text as text_clean, of which something has to be left, and no null in the text or the other
    columns named."""
    cleaned = reviews.dropna(subset=[text, *needed]).withColumn("text_clean", clean_review(F.col(text)))
    return cleaned.where("text_clean <> ''")


def text_scores(rows: DataFrame, scorer: Callable[[list[str]], list[float]] | None, text: str = "text", batch: int = 16, name: str = "bert_score") -> DataFrame:
    """Rows with the scores of a text model called on batches: 0.5 for a batch on which it fails, zeros without a model.

    The scorer goes to the executors and is called there; a model that is heavy to load should load on first use.
    """
    if scorer is None:
        return rows.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[float] = []
            said = texts.fillna("").tolist()
            for i in range(0, len(said), batch):
                try:
                    out += [float(x) for x in scorer(said[i : i + batch])]
                except Exception:  # noqa: BLE001  a model's failure costs its batch, not the job
                    out += [0.5] * len(said[i : i + batch])
            yield pd.Series(out, dtype="float64")

    return rows.withColumn(name, score(F.col(text)))


def single(rows: DataFrame, features_to_score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with is_fake, confidence (the larger probability) and fake_probability of a feature model's score."""
    p = F.col("score")
    return features_to_score(rows).withColumns({"is_fake": p > 0.5, "confidence": F.greatest(p, 1 - p), "fake_probability": p})


def compare_models(metrics: dict[str, DataFrame]) -> DataFrame:
    """(model, accuracy, precision, recall, f1, auc, place): the models by falling accuracy, then by name; best has place 1."""
    from pyspark.sql import Window

    rows = None
    for name, df in metrics.items():
        one = df.select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "auc")
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "model")))  # one row for each model


def best_model(compared: DataFrame) -> DataFrame:
    return compared.where("place = 1")
