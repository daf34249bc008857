"""Review scoring: all features, answers by method, splits, distributions, model comparison and review documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import crossfit, export, monitoring, reviews, scoring, stats, training
from ..sources.shared import staged
from ..sources.tables import REVIEWS_SQL, SCORES_SQL, scores, table
from ..sources.tables import reviews as review_rows
from .queries import _CLEAN, _COUNT, _ENSEMBLE_SQL, _scored
from .registry import query, quoted

# Features

_WORDS = "string_split(regexp_replace(lower(t), '[^\\p{L}]+', ' ', 'g'), ' ')"
_OPINION = {v: f"len(list_filter({_WORDS}, lambda x: x IN ({', '.join(map(quoted, ws))})))" for v, ws in fixed.OPINIONS.items()}
_MEAN = lambda value: f"coalesce(round(({' + '.join(f'{value(v)} * o{i}' for i, v in enumerate(fixed.OPINIONS))}) / CAST(nullif({' + '.join(f'o{i}' for i in range(len(fixed.OPINIONS)))}, 0) AS DOUBLE), 6), 0)"
FEATURES_SQL = f"""{REVIEWS_SQL}, f0 AS (SELECT doc_id, is_fake, CASE WHEN rating = 2 THEN NULL ELSE rating END AS rating, coalesce(text, '') AS t FROM reviews),
 f1 AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w, {', '.join(f'{c} AS o{i}' for i, c in enumerate(_OPINION.values()))} FROM f0),
 f2 AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}+')) AS alpha, CAST(len(w) AS BIGINT) AS n, length(t) AS chars FROM f1),
 features AS (SELECT doc_id, is_fake, chars AS text_length, n AS word_count, round(chars / CAST(greatest(n, 1) AS DOUBLE), 6) AS avg_word_length, {_COUNT('!')} AS exclamation_count, {_COUNT('[?]')} AS question_count, round({_COUNT(chr(92) + 'p{Lu}')} / CAST(greatest(chars, 1) AS DOUBLE), 6) AS capital_ratio, {_COUNT(chr(92) + 'p{Nd}')} AS digit_count,
 round(len(list_distinct(alpha)) / CAST(greatest(len(alpha), 1) AS DOUBLE), 6) AS unique_word_ratio, greatest({_COUNT('[.!?]')}, 1) AS sentence_count, CAST(n < 20 AS INTEGER) AS is_very_short, CAST(n > 150 AS INTEGER) AS is_very_long,
 {_MEAN(lambda v: v)} AS sentiment_polarity, {_MEAN(lambda v: fixed.SUBJECTIVITY[abs(v)])} AS sentiment_subjectivity, coalesce(rating, 3) AS rating, CAST(coalesce(rating IN (1, 5), false) AS INTEGER) AS is_extreme_rating FROM f2)"""


def _features(spark, sf) -> DataFrame:
    """All features of the reviews; a rating of 2 stands for a missing one."""
    rows = review_rows(spark, sf).withColumn("rating", F.when(F.col("rating") != 2, F.col("rating")))
    return training.with_features(rows).select("doc_id", "is_fake", *training.FEATURES)


@query(f"WITH {FEATURES_SQL} SELECT doc_id, {', '.join(training.FEATURES)} FROM features")
def review_feature_vector(spark, sf):
    return _features(spark, sf).select("doc_id", *training.FEATURES)


_CORRELATED = ["text_length", "word_count", "exclamation_count", "capital_ratio", "sentence_count", "rating"]


@query(f"WITH {FEATURES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(is_fake AS DOUBLE)), 6) AS correlation FROM features" for c in _CORRELATED))
def feature_correlations(spark, sf):
    rows = training.with_features(review_rows(spark, sf).withColumn("rating", F.when(F.col("rating") != 2, F.col("rating"))))
    return stats.pearson(rows.select(F.col("is_fake").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in _CORRELATED]), _CORRELATED, "y")


@query(f"WITH {FEATURES_SQL} SELECT CASE WHEN sentiment_polarity > 0 THEN 'positive' WHEN sentiment_polarity < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM features GROUP BY 1")
def sentiment_counts(spark, sf):
    rows = review_rows(spark, sf).select(text.sentiment_label(text.sentiment(F.col("text"))["sentiment_polarity"]).alias("sentiment"))
    return stats.counts_by(rows, ["sentiment"])


_PHRASES = ["is excellent", "bad and slow, sadly", "Parfait !", "terrible, NUL", "bon mais lent", "schön", "", "broken"]
_PHRASE_SQL = f"[{', '.join(map(quoted, _PHRASES))}][p_partkey % {len(_PHRASES)} + 1]"


@query(f"WITH f0 AS (SELECT p_partkey, p_name || ' ' || {_PHRASE_SQL} AS t FROM part), f1 AS (SELECT *, {', '.join(f'{c} AS o{i}' for i, c in enumerate(_OPINION.values()))} FROM f0), f2 AS (SELECT p_partkey, {_MEAN(lambda v: v)} AS sentiment_polarity, {_MEAN(lambda v: fixed.SUBJECTIVITY[abs(v)])} AS sentiment_subjectivity FROM f1) SELECT *, CASE WHEN sentiment_polarity > 0 THEN 'positive' WHEN sentiment_polarity < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM f2")
def sentiment_scores(spark, sf):
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), F.pmod("p_partkey", F.lit(len(_PHRASES))).cast("int") + 1)
    found = text.sentiment(F.concat("p_name", F.lit(" "), phrase))
    rows = table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in found.items()])
    return rows.withColumn("sentiment", text.sentiment_label(F.col("sentiment_polarity")))


_SAID = ["not very good", "very, very bad", "pas du tout vraiment bon", "Never again; good!", "nicht gut, sehr schlecht", "quite nice and not broken", "isn’t it really rather great? no bad", ""]
_LIST = lambda words: "(" + ", ".join(map(quoted, words)) + ")"
_VALUE = "CASE " + " ".join(f"WHEN w IN {_LIST(ws)} THEN {v}::DOUBLE" for v, ws in fixed.OPINIONS.items()) + " END"
_BY = f"pow({fixed.STRONGER_BY}::DOUBLE, strong) * pow({fixed.WEAKER_BY}::DOUBLE, weak)"
_ENDS = "('.', '!', '?', ';')"


@query(
    f"""WITH said AS (SELECT doc_id, coalesce(text, '') || '. ' || [{', '.join(map(quoted, _SAID))}][doc_id % {len(_SAID)} + 1] AS t FROM documents),
 tokens AS (SELECT doc_id, regexp_extract_all(replace(lower(t), '’', {quoted("'")}), {quoted(fixed.WORD_OR_END)}) AS ws FROM said),
 each_one AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tokens),
 sentences AS (SELECT *, count(CASE WHEN w IN {_ENDS} THEN 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS sentence FROM each_one),
 words AS (SELECT doc_id, sentence, i, w, {_VALUE} AS v, CAST(w IN {_LIST(fixed.STRONGER)} AS INTEGER) AS is_strong, CAST(w IN {_LIST(fixed.WEAKER)} AS INTEGER) AS is_weak, w IN {_LIST(fixed.NEGATIONS)} AS turns FROM sentences WHERE w NOT IN {_ENDS}),
 runs AS (SELECT *, count(CASE WHEN is_strong + is_weak = 0 THEN 1 END) OVER (PARTITION BY doc_id, sentence ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run,
 max(CASE WHEN turns THEN i END) OVER near AS last_turn, max(CASE WHEN v IS NOT NULL THEN i END) OVER near AS last_opinion FROM words WINDOW near AS (PARTITION BY doc_id, sentence ORDER BY i ROWS BETWEEN {fixed.NEGATION_REACH} PRECEDING AND 1 PRECEDING)),
 counted AS (SELECT *, sum(is_strong) OVER (PARTITION BY doc_id, sentence, run) AS strong, sum(is_weak) OVER (PARTITION BY doc_id, sentence, run) AS weak, last_turn IS NOT NULL AND last_turn > coalesce(last_opinion, 0) AS turned FROM runs),
 valued AS (SELECT doc_id, turned, greatest(-1, least(1, v * {_BY} * CASE WHEN turned THEN {fixed.NEGATED}::DOUBLE ELSE 1 END)) AS p, least(1, CASE abs(v) {' '.join(f'WHEN {k} THEN {x}::DOUBLE' for k, x in fixed.SUBJECTIVITY.items())} END * {_BY}) AS s FROM counted WHERE v IS NOT NULL)
 SELECT d.doc_id, coalesce(round(avg(p), 6), 0) AS sentiment_polarity, coalesce(round(avg(s), 6), 0) AS sentiment_subjectivity, count(p) AS opinions, count(CASE WHEN turned THEN 1 END) AS negated FROM documents d LEFT JOIN valued USING (doc_id) GROUP BY 1"""
)
def sentiment_phrases(spark, sf):
    """Sentiment of texts with negated and strengthened opinions at their ends, by a fold over the words."""
    said = F.element_at(F.array(*[F.lit(p) for p in _SAID]), F.pmod("doc_id", F.lit(len(_SAID))).cast("int") + 1)
    found = text.phrase_sentiment(F.concat(F.coalesce("text", F.lit("")), F.lit(". "), said))
    return table(spark, sf, "documents").select("doc_id", found.alias("found")).select("doc_id", "found.*")


@query(f"WITH {REVIEWS_SQL}, g AS (SELECT is_fake, CAST(length(text) AS DOUBLE) AS x FROM reviews), q AS (SELECT is_fake, quantile_cont(x, 0.25) AS a, median(x) AS m, quantile_cont(x, 0.75) AS b FROM g GROUP BY 1) SELECT g.is_fake, round(a, 4) AS q1, round(m, 4) AS median, round(b, 4) AS q3, min(CASE WHEN x BETWEEN a - (b - a) * 1.5 AND b + (b - a) * 1.5 THEN x END) AS low, max(CASE WHEN x BETWEEN a - (b - a) * 1.5 AND b + (b - a) * 1.5 THEN x END) AS high, count(CASE WHEN NOT x BETWEEN a - (b - a) * 1.5 AND b + (b - a) * 1.5 THEN 1 END) AS outliers FROM g JOIN q USING (is_fake) GROUP BY ALL")
def length_box_plot(spark, sf):
    return stats.box_plot(review_rows(spark, sf).withColumn("x", F.char_length("text").cast("double")), "x", ["is_fake"])


@query(f"WITH {REVIEWS_SQL}, s AS (SELECT is_fake, count(*) AS n, avg(length(text)) AS m, var_samp(length(text)) AS v FROM reviews GROUP BY 1), one AS (SELECT a.m AS ma, b.m AS mb, a.n + b.n - 2 AS freedom, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t FROM s a, s b WHERE a.is_fake = 1 AND b.is_fake = 0) SELECT round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(t, 4) AS t, freedom, {stats.p_value_sql(f'(SELECT sum({{}}) FROM range({stats.P_STEPS + 1}) r(k))')} AS p_value FROM one")
def ttest_length_p(spark, sf):
    """The pooled t test with its p value, against numerical integration in a test."""
    return stats.t_test(review_rows(spark, sf).select(F.char_length("text").alias("x"), "is_fake"), "x", F.col("is_fake") == 1)


@query(f"WITH {REVIEWS_SQL} SELECT count(*) AS reviews, CAST(sum(is_fake) AS BIGINT) AS fakes, round(avg(is_fake) * 100, 4) AS fake_pct, round(avg(rating), 4) AS rating_mean, round(stddev_samp(rating), 4) AS rating_std, round(avg(length(text)), 4) AS length_mean FROM reviews")
def review_summary(spark, sf):
    return reviews.summary(review_rows(spark, sf), "is_fake", "rating", F.char_length("text"))


@query(f"WITH {REVIEWS_SQL}, s AS (SELECT is_fake, CASE WHEN row_number() OVER (PARTITION BY is_fake ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY is_fake) * 0.8) THEN 'train' ELSE 'test' END AS part FROM reviews) SELECT part, count(*) AS n, round(avg(is_fake), 6) AS share FROM s GROUP BY 1")
def split_class_balance(spark, sf):
    return reviews.class_balance(reviews.stratified_split(review_rows(spark, sf).select("doc_id", "is_fake"), "doc_id", "is_fake"), "is_fake")


@query(f"WITH {REVIEWS_SQL}, z AS (SELECT count(*) AS n, least(greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)), count(*) - 2) AS t FROM reviews), g AS (SELECT is_fake, count(*) * 1.0::DOUBLE * any_value(t) / any_value(n) AS x FROM reviews, z GROUP BY 1), q AS (SELECT is_fake, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, is_fake) <= (SELECT t FROM z) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS q FROM g) SELECT doc_id, r.is_fake, CASE WHEN row_number() OVER (PARTITION BY r.is_fake ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= q THEN 'test' ELSE 'train' END AS part FROM reviews r JOIN q USING (is_fake)")
def sized_split(spark, sf):
    return reviews.sized_split(review_rows(spark, sf).select("doc_id", "is_fake"), "doc_id", "is_fake").select("doc_id", "is_fake", "part")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return reviews.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


# Requests and answers


@query("SELECT doc_id, length(trim(coalesce(text, ''), ' ')) >= 10 AS accepted, CASE WHEN length(trim(coalesce(text, ''), ' ')) >= 10 THEN 200 ELSE 400 END AS status FROM documents")
def request_guard(spark, sf):
    return scoring.guard(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "accepted", "status")


@query("SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1")
def usable_reviews(spark, sf):
    return scoring.usable(table(spark, sf, "documents").select("doc_id", "text", "lang"), "text", "lang").groupBy("lang").agg(F.count("*").alias("n"))


_CLEANED = "trim(" + _CLEAN.replace("coalesce(text, '')", "coalesce(said, '')") + ")"


@query(f"WITH s AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN 'https://shop.example/p/1 me@shop.example' WHEN 1 THEN '<br> -- ' ELSE text END AS said FROM documents) SELECT lang, count(*) AS n, CAST(sum(length({_CLEANED})) AS BIGINT) AS chars FROM s WHERE said IS NOT NULL AND lang IS NOT NULL AND {_CLEANED} <> '' GROUP BY 1")
def usable_cleaned_reviews(spark, sf):
    """Reviews of which something is left after cleaning; of some, nothing is: they hold an address or a tag alone."""
    said = F.when(F.col("doc_id") % 5 == 0, "https://shop.example/p/1 me@shop.example").when(F.col("doc_id") % 5 == 1, "<br> -- ").otherwise(F.col("text"))
    rows = scoring.usable_cleaned(table(spark, sf, "documents").select("doc_id", "lang", said.alias("said")), "said", "lang")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text_clean")).alias("chars"))


_METHOD_SQL = "CASE doc_id % 4 WHEN 0 THEN 'bert_only' WHEN 1 THEN 'xgboost_only' WHEN 2 THEN 'ensemble' ELSE 'other' END"


@query(f"WITH {SCORES_SQL}, m AS (SELECT doc_id, bert_score AS p, CASE {_METHOD_SQL} WHEN 'bert_only' THEN 'BERT' WHEN 'xgboost_only' THEN 'BERT' WHEN 'ensemble' THEN 'Ensemble (BERT-only)' END AS model FROM scores) SELECT doc_id, model, CASE WHEN model IS NOT NULL THEN CASE WHEN p > 1 - p THEN 'FAKE' ELSE 'REAL' END END AS prediction, CASE WHEN model IS NOT NULL THEN round(greatest(p, 1 - p) * 100, 4) END AS confidence, CASE WHEN model IS NOT NULL THEN round(p * 100, 4) END AS probability_fake, CASE WHEN model IS NOT NULL THEN round((1 - p) * 100, 4) END AS probability_real FROM m")
def predictions_by_method(spark, sf):
    which = F.element_at(F.array(*[F.lit(m) for m in ("bert_only", "xgboost_only", "ensemble", "other")]), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    return scoring.by_method(scores(review_rows(spark, sf)), which).select("doc_id", "model", "prediction", "confidence", "probability_fake", "probability_real")


@query(f"WITH {SCORES_SQL}, l AS (SELECT doc_id, (xgboost_score - 0.5) * 8 AS fake, (bert_score - 0.5) * 8 AS real FROM scores), p AS (SELECT doc_id, 1 / (1 + exp(real - fake)) AS p FROM l) SELECT doc_id, round(p, 6) AS p, CASE WHEN p > 1 - p THEN 'FAKE' ELSE 'REAL' END AS prediction FROM p")
def softmax_labels(spark, sf):
    rows = scores(review_rows(spark, sf)).withColumn("p", scoring.softmax((F.col("xgboost_score") - 0.5) * 8, (F.col("bert_score") - 0.5) * 8))
    return rows.select("doc_id", F.round("p", 6).alias("p"), scoring.answer(F.col("p"))["prediction"].alias("prediction"))


_METRICS = lambda c: f"""{c}_c AS (SELECT count(CASE WHEN is_fake = 1 AND {c} > 0.5 THEN 1 END) AS tp, count(CASE WHEN is_fake = 0 AND {c} > 0.5 THEN 1 END) AS fp, count(CASE WHEN is_fake = 1 AND {c} <= 0.5 THEN 1 END) AS fn, count(*) AS n FROM done),
 {c}_r AS (SELECT is_fake, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k FROM done),
 {c}_m AS (SELECT round((n - fp - fn) / CAST(n AS DOUBLE), 6) AS accuracy, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1, (SELECT round((sum(CASE WHEN is_fake = 1 THEN k END) - sum(is_fake) * (sum(is_fake) + 1) / 2.0) / (sum(is_fake) * 1.0 * sum(1 - is_fake)), 6) FROM {c}_r) AS auc FROM {c}_c)"""  # noqa: E731
_MODELS = ["bert_score", "ensemble_score", "xgboost_score"]


def _compared(spark, sf) -> DataFrame:
    rows = _scored(spark, sf)
    return scoring.compare_models({c: reviews.metrics(rows.withColumn("_y", (F.col(c) > 0.5).cast("int")), "is_fake", "_y", c) for c in _MODELS})


_COMPARED_SQL = f"{_ENSEMBLE_SQL}, {', '.join(_METRICS(c) for c in _MODELS)}, every AS ({' UNION ALL '.join(f'SELECT {quoted(c)} AS model, * FROM {c}_m' for c in _MODELS)}), placed AS (SELECT *, CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS INTEGER) AS place FROM every)"


@query(f"WITH {_COMPARED_SQL} SELECT * FROM placed")
def model_comparison(spark, sf):
    return _compared(spark, sf)


@query(f"WITH {_COMPARED_SQL} SELECT model, accuracy FROM placed WHERE place = 1")
def best_model(spark, sf):
    return scoring.best_model(_compared(spark, sf)).select("model", "accuracy")


@query(f"WITH {_COMPARED_SQL} SELECT accuracy, 0.85::DOUBLE AS baseline, round(0.85 - accuracy, 6) AS degradation, accuracy < 0.85::DOUBLE - 0.05::DOUBLE AS alert FROM placed")
def accuracy_degradation(spark, sf):
    return monitoring.degraded(_compared(spark, sf))


@query(f"WITH {_ENSEMBLE_SQL} SELECT is_fake_predicted, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM done GROUP BY 1")
def fake_summary(spark, sf):
    return reviews.fake_share(_scored(spark, sf), "is_fake_predicted")


@query(f"WITH {_ENSEMBLE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS score, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std FROM done" for c in _MODELS))
def model_score_table(spark, sf):
    return reviews.score_table(_scored(spark, sf), _MODELS)


@query(f"WITH {_ENSEMBLE_SQL}, o AS (SELECT round(avg(ensemble_score), 6) AS mean, count(CASE WHEN ensemble_score > 0.95 THEN 1 END) AS sure, round(count(CASE WHEN ensemble_score > 0.95 THEN 1 END) / CAST(count(ensemble_score) AS DOUBLE), 6) AS share FROM done) SELECT *, mean > 0.9 OR mean < 0.1 AS mean_alert, share > 0.1 AS share_alert FROM o")
def score_distribution(spark, sf):
    return monitoring.score_distribution(_scored(spark, sf), "ensemble_score")


_REVIEW_DOC = "text, rating, author, language, is_fake, fake_probability, xgboost_score, bert_score, ensemble_score, confidence, sentiment"


@query(
    f"WITH {_ENSEMBLE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM done), p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS j FROM part), n AS (SELECT least((SELECT count(*) FROM r), (SELECT count(*) FROM p)) AS n)"
    " SELECT format('review_{:06d}', i) AS _id, p_partkey AS product_id, md5(coalesce(text, '')) AS text, coalesce(rating, 5) AS rating, 'Anonymous' AS author, coalesce(language, 'fr') AS language, is_fake = 1 AS is_fake, ensemble_score AS fake_probability, xgboost_score, bert_score, ensemble_score, confidence, 'neutral' AS sentiment FROM r, n, p WHERE j = i % n"
)
def review_documents(spark, sf):
    rows = _scored(spark, sf).withColumn("fake_probability", F.col("ensemble_score"))
    docs = export.review_documents(rows, table(spark, sf, "part"), "doc_id", "p_partkey")
    return docs.withColumn("text", F.md5(F.col("text").cast("binary"))).select("_id", "product_id", *_REVIEW_DOC.split(", "))


# Scores from models that never saw the review; no SQL: tests hold them against models fitted fold by fold


def _blended(spark, sf) -> DataFrame:
    return crossfit.blended_scores(review_rows(spark, sf).select("doc_id", "text", "rating", "is_fake"))


@query()
def cross_fitted_scores(spark, sf):
    """Both models' scores of each review and their blend."""
    return _blended(spark, sf).select("doc_id", "fold", *[F.round(c, 6).alias(c) for c in ("xgboost_score", "bert_score", "ensemble_score")], "confidence", "is_fake_predicted")


@query()
def cross_fitted_metrics(spark, sf):
    """How good the blend is on reviews that its models never saw."""
    answers = staged(_blended(spark, sf).select("is_fake", "is_fake_predicted", "ensemble_score"))  # read several times
    return reviews.metrics(answers, "is_fake", "is_fake_predicted", "ensemble_score")


@query()
def single_answers(spark, sf):
    """What a fitted model answers to each review that it was not fitted on: fake or not, and how sure it is."""
    rows = training.with_features(reviews.stratified_split(review_rows(spark, sf), "doc_id", "is_fake"))
    model = training.fit(rows.where("part = 'train'"), "logreg", "is_fake")
    answers = scoring.single(rows.where("part = 'test'"), lambda df: training.predict(model, df))
    return answers.select("doc_id", F.col("is_fake"), F.round("confidence", 6).alias("confidence"), F.round("fake_probability", 6).alias("fake_probability"))


@query(f"WITH {REVIEWS_SQL} SELECT doc_id, is_fake FROM reviews UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM reviews)")
def labels_from_codes(spark, sf):
    """Labels from the classes of labelled reviews; reviews without a class are not fake."""
    coded = review_rows(spark, sf).select("doc_id", F.when(F.col("is_fake") == 1, fixed.FAKE_CODE).otherwise("OR").alias("label"))
    rows = table(spark, sf, "documents").select("doc_id").join(coded, "doc_id", "left")
    return rows.select("doc_id", reviews.label_of_code(F.col("label")).alias("is_fake"))


@query(f"WITH {REVIEWS_SQL} SELECT rating, count(*) AS n, CAST(sum(is_fake) AS BIGINT) AS fakes, round(avg(is_fake) * 100, 4) AS pct FROM reviews WHERE is_fake IS NOT NULL GROUP BY 1")
def fake_share_by_rating(spark, sf):
    return reviews.fake_share_by(review_rows(spark, sf), "rating", "is_fake")


@query(
    f"""WITH {REVIEWS_SQL}, s AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS x, row_number() OVER (PARTITION BY is_fake ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY is_fake) * 0.8) AS train FROM reviews),
 f AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM s WHERE train) SELECT doc_id, CASE WHEN train THEN 'train' ELSE 'test' END AS part, round((x - m) / d, 4) AS x FROM s, f"""
)
def scale_fitted_on_train(spark, sf):
    """Lengths scaled by what training rows alone are like."""
    rows = reviews.stratified_split(review_rows(spark, sf).select("doc_id", "is_fake", F.char_length("text").cast("double").alias("x")), "doc_id", "is_fake")
    return reviews.scaled_by(rows, rows.where("part = 'train'"), ["x"]).select("doc_id", "part", "x")
