"""Registered text / label function queries (C1-C12, A9) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedpulse.functions import text as X
from feedpulse.plans.registry import register
from feedpulse.plans.views import emails, feedback, interactions, reviews, texts, with_views
from feedpulse.sources.tables import table

WS = X.WS
_VI = f"[^{X.VI_LETTERS}{WS}]"
_WORD = rf"[^\p{{L}}\p{{N}}_{WS}]"


def _sq(s: str) -> str:
    return s.replace("'", "''")


def sql_clean_words(c: str) -> str:
    return f"regexp_replace(lower({c}), '{_sq(_WORD)}', '', 'g')"


def sql_clean_trend(c: str) -> str:
    return f"trim(regexp_replace({sql_clean_words(c)}, '[{WS}]+', ' ', 'g'), ' ')"


@register("clean_vi", with_views(
    f"select doc_id, regexp_replace(lower(text), '{_sq(_VI)}', '', 'g') as clean_text from texts", "texts"))
def q_clean_vi(spark, sf):
    return texts(spark, sf).select("doc_id", X.clean_vi("text").alias("clean_text"))


@register("clean_words", with_views(
    f"select doc_id, {sql_clean_words('text')} as clean_text from texts", "texts"))
def q_clean_words(spark, sf):
    return texts(spark, sf).select("doc_id", X.clean_words("text").alias("clean_text"))


@register("clean_trend_text", with_views(
    f"select doc_id, {sql_clean_trend('text')} as clean_text from texts", "texts"))
def q_clean_trend(spark, sf):
    return texts(spark, sf).select("doc_id", X.clean_trend("text").alias("clean_text"))


@register("clean_trend_documents",
          f"select doc_id, {sql_clean_trend('text')} as clean_text from documents")
def q_clean_trend_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_trend("text").alias("clean_text"))


@register("clean_basic", with_views(
    f"select conv_id, turn, regexp_replace(lower(coalesce(text, '')), '^[{WS}]+|[{WS}]+$', '', 'g') as clean_text "
    "from emails", "emails"))
def q_clean_basic(spark, sf):
    return emails(spark, sf).select("conv_id", "turn", X.clean_basic(X.null_text("text")).alias("clean_text"))


@register("full_description", with_views(
    "select l_orderkey, l_linenumber, l_partkey, lower(concat_ws(' ', coalesce(title, ''), '', coalesce(name, ''), "
    "coalesce(manufacturer, ''), coalesce(categories, ''))) as full_description from interactions", "interactions"))
def q_full_description(spark, sf):
    return interactions(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        X.full_description(text=F.lit(None).cast("string")).alias("full_description"))


@register("spam_target_strict", with_views(
    "select conv_id, turn, label, cast(case when label = 'spam' then 1 when label = 'ham' then 0 end as int) as target "
    "from emails", "emails"))
def q_spam_target_strict(spark, sf):
    return emails(spark, sf).select("conv_id", "turn", "label", X.spam_target("label", "strict").alias("target"))


@register("spam_target_one_vs_rest", with_views(
    "select conv_id, turn, label, cast(case when label = 'spam' then 1 else 0 end as int) as target from emails",
    "emails"))
def q_spam_target_ovr(spark, sf):
    return emails(spark, sf).select("conv_id", "turn", "label",
                                    X.spam_target("label", "one_vs_rest").alias("target"))


@register("translate_label", with_views(
    "select doc_id, label, case label when 'negative' then 'tiêu cực' when 'positive' then 'tích cực' "
    "when 'neutral' then 'trung tính' else label end as display from reviews", "reviews"))
def q_translate_label(spark, sf):
    return reviews(spark, sf).select("doc_id", "label", X.translate_label("label").alias("display"))


@register("norm_sentiment_text", with_views(
    "select doc_id, upper(substr(label, 1, 1)) || lower(substr(label, 2)) as sentiment from reviews", "reviews"))
def q_norm_sentiment_text(spark, sf):
    return reviews(spark, sf).select("doc_id", X.norm_sentiment("label").alias("sentiment"))


@register("norm_sentiment_code",
          "select event_id, cast(floor(value) as int) % 4 as code, case cast(floor(value) as int) % 4 when 0 then 'Negative' "
          "when 1 then 'Positive' when 2 then 'Neutral' else 'Neutral' end as sentiment from events")
def q_norm_sentiment_code(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.floor("value").cast("int") % 4).alias("code"))
    return e.select("event_id", "code", X.norm_sentiment("code", integral=True).alias("sentiment"))


@register("rule_labels", with_views(
    f"""select doc_id,
       case when contains(c, 'pin') then 'Battery' when contains(c, 'ship') then 'Shipping' else 'Other' end as topic,
       case when contains(c, 'yếu') then 'Negative' else 'Positive' end as sentiment
    from (select doc_id, {sql_clean_trend('text')} as c from texts) t""", "texts"))
def q_rule_labels(spark, sf):
    c = texts(spark, sf).select("doc_id", X.clean_trend("text").alias("c"))
    return c.select("doc_id", X.rule_topic("c").alias("topic"), X.rule_sentiment("c").alias("sentiment"))


@register("spam_label", with_views(
    "select conv_id, turn, case when is_spam then 'spam' else 'ham' end as spam_label from emails", "emails"))
def q_spam_label(spark, sf):
    return emails(spark, sf).select("conv_id", "turn", X.spam_label("is_spam").alias("spam_label"))


@register("clip_rating", with_views(
    "select l_orderkey, l_linenumber, l_extendedprice, "
    "round(least(greatest(l_extendedprice / 10000.0, 1.0), 5.0), 2) as predicted_rating from interactions",
    "interactions"))
def q_clip_rating(spark, sf):
    return interactions(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        X.clip_rating(F.col("l_extendedprice") / 10000.0, round_to=2).alias("predicted_rating"))


@register("null_nonfinite", with_views(
    """select id, case when isfinite(v) then v end as value_safe,
       case when isfinite(v) then least(greatest(v, 1.0), 5.0) else 3.0 end as rating_safe
    from (select id, case when value > 400 then 'nan'::double when value < 1 then 'inf'::double
                          when value < 2 then '-inf'::double else value end as v from feedback) t""", "feedback"))
def q_null_nonfinite(spark, sf):
    v = (F.when(F.col("value") > 400, F.lit(float("nan")))
          .when(F.col("value") < 1, F.lit(float("inf")))
          .when(F.col("value") < 2, F.lit(float("-inf"))).otherwise(F.col("value")))
    d = feedback(spark, sf).select("id", v.alias("v"))
    return d.select("id", X.null_nonfinite("v").alias("value_safe"), X.clip_rating("v").alias("rating_safe"))
