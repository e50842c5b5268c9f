"""Batch scoring with fitted pipelines.

Each scorer resolves its input columns once, cleans text with column
expressions and runs ``model.transform`` -- a map-only plan, no shuffle.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.functions import schema as S
from feedpulse.functions import text as X
from feedpulse.operators import features as D

# Text column aliases of the scoring service and the trend API.
SCORE_TEXT_ALIASES = ("text", "comment", "content")
TREND_TEXT_ALIASES = ("comment", "reviews.text", "content", "feedback")
TREND_DATE_ALIASES = ("date", "time", "created_at")
EMAIL_TEXT_ALIASES = ("text", "content", "body", "email")
EMAIL_DATES = ("date", "timestamp")
MISSING_PROBABILITY = 0.5


def confidence(prob: Column | str, digits: int = 4) -> Column:
    """max class probability of a probability vector, rounded."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.round(F.array_max(vector_to_array(p)), digits)


def binary_confidence(p: Column | str, digits: int = 4) -> Column:
    """F1 (1-D case): max(p, 1 - p)."""
    p = F.col(p) if isinstance(p, str) else p
    return F.round(F.greatest(p, 1 - p), digits)


def _text(df: DataFrame, aliases) -> str:
    src = S.first_present(df.columns, aliases)
    if src is None:
        raise ValueError(f"input must contain one of {list(aliases)}")
    return src


def score_topic(df: DataFrame, model, text_aliases=SCORE_TEXT_ALIASES) -> DataFrame:
    """topic label and confidence (normalised one-vs-rest probabilities)."""
    src = _text(df, text_aliases)
    d = df.withColumn("text", X.clean_basic(X.null_text(F.col(f"`{src}`"), "nan")))
    out = model.transform(d)
    return out.select(*df.columns, F.col("predicted_label").alias("topic"),
                      F.round(F.array_max("probability_arr"), 4).alias("confidence"))


def score_sentiment(df: DataFrame, model, text_aliases=SCORE_TEXT_ALIASES) -> DataFrame:
    """display sentiment and confidence (0.5 when no probability)."""
    src = _text(df, text_aliases)
    d = df.withColumn("text", X.null_text(F.col(f"`{src}`"), "nan"))
    out = model.transform(d)
    conf = confidence("probability") if "probability" in out.columns else F.lit(MISSING_PROBABILITY)
    return out.select(*df.columns, X.translate_label("predicted_label").alias("sentiment"),
                      F.coalesce(conf, F.lit(MISSING_PROBABILITY)).alias("confidence"))


def score_email(df: DataFrame, model) -> DataFrame:
    """spam / ham label, flag, confidence and (when present) a date, from a ``LinearTextModel``.

    Without the model's text column, the first of the text aliases is lower-cased and cleaned for it.
    Rows need the model's document column. The date is the column named ``date`` or ``timestamp``.
    """
    src = df
    text = model.spec.text_col
    if text not in df.columns:
        found = _text(df, EMAIL_TEXT_ALIASES)
        src = df.withColumn(text, X.clean_words(X.null_text(F.col(f"`{found}`"))))
    out = model.transform(src)
    is_spam = F.coalesce(F.col("prediction") == 1, F.lit(False))
    cols = [*df.columns, X.spam_label(is_spam).alias("label_pred"), is_spam.alias("is_spam_pred"),
            binary_confidence(F.coalesce(F.col("probability"), F.lit(MISSING_PROBABILITY))).alias("confidence")]
    date_src = next((c for n in EMAIL_DATES for c in df.columns if c.lower() == n), None)
    if date_src:
        cols.append(S.to_ts(F.col(f"`{date_src}`")).alias("date_ts"))
    return out.select(*cols)


def score_rating(df: DataFrame, model, user_dict: DataFrame, item_dict: DataFrame) -> DataFrame:
    """predicted rating per (user, product); unseen ids -> index 0 and cold start."""
    d = S.rename_aliases(df, S.SCORING_RENAME)
    for c in ("title", "text", "name", "manufacturer", "categories"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(""))
    d = d.withColumn("full_description", X.full_description())
    d = D.apply_index(d, user_dict, "user_id", "user_idx", "__cold_u", value_col="user_idx")
    d = D.apply_index(d, item_dict, "product_id", "item_idx", "__cold_i", value_col="item_idx", dict_key="item_id")
    out = model.transform(d.withColumn("user_idx", F.col("user_idx").cast("double"))
                           .withColumn("item_idx", F.col("item_idx").cast("double")))
    return out.select(*[c for c in df.columns if c in out.columns],
                      X.clip_rating("prediction").alias("predicted_rating"),
                      (F.col("__cold_u") | F.col("__cold_i")).alias("is_cold_start"))


def score_two_heads(df: DataFrame, model, text_col: str = "clean_text") -> DataFrame:
    """topic and sentiment with their confidences, from a pipeline of ``train_feed`` (one tokenise and
    weight pass). ``text_col`` stands in for the pipeline's own text column; the input's columns stay as they are."""
    own = model.stages[0].getStatement().split("coalesce(`")[1].split("`")[0]
    keep = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(df.columns)]
    d = df.select(*keep, F.col(f"`{text_col}`").alias(own))
    out = model.transform(d)
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(df.columns)], F.col("topic_predicted_label").alias("topic"),
                      F.round(F.array_max("topic_probability_arr"), 4).alias("topic_confidence"),
                      X.norm_sentiment("sentiment_predicted_label").alias("sentiment"),
                      F.round(F.array_max("sentiment_probability_arr"), 4).alias("sentiment_confidence"))


def score_feed(df: DataFrame, topic_model=None, sentiment_model=None, text_col: str = "clean_text",
               feed_model=None) -> DataFrame:
    """topic and sentiment for a cleaned feed in one plan: by a two-headed pipeline, by two models, or by
    keyword rules when there is no model."""
    if feed_model is not None:
        return score_two_heads(df, feed_model, text_col).drop("topic_confidence", "sentiment_confidence")
    if topic_model is None or sentiment_model is None:
        return df.withColumn("topic", X.rule_topic(text_col)).withColumn("sentiment", X.rule_sentiment(text_col))
    t = score_topic(df.withColumn("text", F.col(text_col)), topic_model).drop("confidence")
    s = sentiment_model.transform(t.withColumn("text", F.col(text_col)))
    return s.select(*t.columns, X.norm_sentiment("predicted_label").alias("sentiment"))


def prepare_feed(raw: DataFrame) -> DataFrame:
    """Trend ingest: resolve date and text, lenient UTC timestamp, drop bad dates, clean text."""
    tsrc = _text(raw, TREND_TEXT_ALIASES)
    dsrc = _text(raw, TREND_DATE_ALIASES)
    d = raw.select(S.to_ts(F.col(f"`{dsrc}`")).alias("date"), F.col(f"`{tsrc}`").alias("comment"))
    d = S.drop_null(d, ["date"])
    return d.withColumn("clean_text", X.clean_trend(X.null_text("comment", "nan")))
