"""Registered schema-resolution and cast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedpulse.functions import schema as S
from feedpulse.plans.registry import register
from feedpulse.plans.views import emails, interactions, reviews, with_views
from feedpulse.sources.tables import table

RECSYS_ALIASES, RECSYS_TEXT_DEFAULTS, SCORING_RENAME = S.RECSYS_ALIASES, S.RECSYS_TEXT_DEFAULTS, S.SCORING_RENAME


@register("resolve_recsys", with_views(
    "select user_id, item_id, rating, title, '' as text, name, manufacturer, categories from interactions "
    "where user_id is not null and item_id is not null and rating is not null", "interactions"))
def q_resolve_recsys(spark, sf):
    r = S.resolve(interactions(spark, sf), RECSYS_ALIASES, RECSYS_TEXT_DEFAULTS)
    return S.drop_null(r, ["user_id", "item_id", "rating"])


@register("rename_aliases", with_views(
    "select user_id, coalesce(item_id) as product_id, title, rating from interactions", "interactions"))
def q_rename_aliases(spark, sf):
    d = interactions(spark, sf).select("user_id", "item_id", "title", "rating")
    return S.rename_aliases(d, SCORING_RENAME)


@register("resolve_contains",
          "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as date_col from events")
def q_resolve_contains(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("event_timestamp"))
    src = S.first_present(e.columns, ["date", "timestamp"], contains=True)
    return e.select("event_id", F.date_format(F.col(src), "yyyy-MM-dd HH:mm:ss").alias("date_col"))


@register("to_ts", """select event_id,
    strftime(try_cast(case when event_id % 7 = 0 then 'not a date'
                           else strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' end as timestamp), '%Y-%m-%d %H:%M:%S')
      as parsed
    from events""")
def q_to_ts(spark, sf):
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_id") % 7 == 0, F.lit("not a date")) \
           .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return e.select("event_id", F.date_format(S.to_ts(txt), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("to_num", """select event_id,
    try_cast(regexp_extract(props, ': ([0-9]+)', 1) as double) as k,
    coalesce(try_cast(props as double), 0.0) as k_fill
    from events""")
def q_to_num(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.to_num(F.regexp_extract("props", r": ([0-9]+)", 1)).alias("k"),
                    S.to_num("props", fill=0.0).alias("k_fill"))


@register("to_flag", with_views(
    "select conv_id, turn, lower(cast(is_spam as varchar)) in ('true', '1') as flag from emails", "emails"))
def q_to_flag(spark, sf):
    return emails(spark, sf).select("conv_id", "turn", S.to_flag("is_spam").alias("flag"))


@register("sufficient", with_views(
    "select count(*) as n_rows, count(distinct label) as n_classes, "
    "count(*) >= 3 and count(distinct label) >= 2 as sufficient from reviews", "reviews"))
def q_sufficient(spark, sf):
    return S.sufficient(reviews(spark, sf), "label")


@register("review_label_counts", with_views(
    "select label, count(*) as count from reviews group by label", "reviews"))
def q_review_label_counts(spark, sf):
    return S.label_counts(reviews(spark, sf), "label")


@register("normalize_columns", "select event_id, event_type from events")
def q_normalize_columns(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("Event_ID"), F.col("event_type").alias("EVENT_TYPE"))
    return S.normalize_columns(e)


@register("validation_errors", """select * from (values ('email', 'email: missing column ''label'''),
    ('email', 'email: missing column ''date'''), ('rating', 'rating: missing column ''product_id''')) v(input, error)
    union all select 'trend', 'trend: no rows' where not exists (select 1 from events where value < -1)""")
def q_validation_errors(spark, sf):
    """All errors of the dashboard's inputs at once, as a table."""
    e = emails(spark, sf).select("text", "is_spam")
    r = interactions(spark, sf).select(F.col("rating").alias("predicted_rating"), "user_id")
    t = table(spark, sf, "events").where("value < -1").select(F.col("ts").alias("date"), F.col("event_type").alias("topic"))
    found = [("email", S.validate(e, ["label", "is_spam", "date"], "email")), ("rating", S.validate(r, ["product_id", "predicted_rating"], "rating")),
             ("trend", S.validate(t, ["date", "topic"], "trend"))]
    return spark.createDataFrame([(n, x) for n, xs in found for x in xs], "input string, error string")
