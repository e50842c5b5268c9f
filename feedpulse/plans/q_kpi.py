"""Registered KPI queries (H1-H21) over the trend cube, ratings and emails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpulse.functions.schema import normalize_columns
from feedpulse.operators import kpi as K
from feedpulse.operators.trend import trend_daily
from feedpulse.plans.registry import register
from feedpulse.plans.views import add_view_sql, day_from_no, emails, feedback, interactions, with_views
from feedpulse.sources.tables import table


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both engines do the same in the oracle SQL)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


def cube(spark, sf) -> DataFrame:
    return normalize_columns(trend_daily(feedback(spark, sf)))


def ratings(spark, sf) -> DataFrame:
    return interactions(spark, sf).select(
        F.col("item_id").alias("product_id"), F.col("rating").cast("double").alias("predicted_rating"),
        "user_id", "date")


def mails(spark, sf) -> DataFrame:
    return emails(spark, sf).select("conv_id", "turn", "label", "is_spam",
                                    day_from_no(F.col("day_no")).alias("date"))


add_view_sql("cube", """select date, topic,
  count(*) filter (where sentiment = 'Negative') as negative,
  count(*) filter (where sentiment = 'Positive') as positive,
  count(*) filter (where sentiment = 'Neutral') as neutral,
  count(*) filter (where sentiment in ('Negative','Positive','Neutral')) as total_volume
  from feedback where date is not null group by date, topic""", ("feedback",))
add_view_sql("ratings", """select item_id as product_id, cast(rating as double) as predicted_rating,
  user_id, date from interactions""", ("interactions",))
add_view_sql("mails", """select conv_id, turn, label, is_spam, date '2024-01-01' + day_no as date
  from emails""", ("emails",))
add_view_sql("daily", "select date, cast(sum(total_volume) as bigint) as total_volume from cube where date is not null group by date",
             ("cube",))
add_view_sql("tstats", """select topic, negative, total_volume, positive,
  case when total_volume > 0 then negative / total_volume * 100 else 0.0 end as neg_rate,
  (case when total_volume > 0 then negative / total_volume * 100 else 0.0 end) * total_volume as severity
  from (select topic, cast(sum(negative) as bigint) as negative, cast(sum(total_volume) as bigint) as total_volume,
              cast(sum(positive) as bigint) as positive
        from cube group by topic) s""", ("cube",))
add_view_sql("growth", """select topic,
   cast(case when nr > 0 and np > 0 then r - p else 0 end as double) as growth,
   case when np > 0 and p <> 0 then (case when nr > 0 and np > 0 then r - p else 0 end) / abs(p) * 100
        else 0.0 end as growth_pct
  from (select topic,
          sum(total_volume) filter (where date >= mx - 6) as r,
          sum(total_volume) filter (where date >= mx - 13 and date < mx - 6) as p,
          count(*) filter (where date >= mx - 6) as nr,
          count(*) filter (where date >= mx - 13 and date < mx - 6) as np
        from cube, (select max(date) as mx from cube) m where date is not null group by topic) g
  where nr > 0 or np > 0""", ("cube",))
add_view_sql("pstats", """select product_id, avg(predicted_rating) as avg_rating,
  count(predicted_rating) as review_count, stddev_samp(predicted_rating) as rating_std,
  avg(case when predicted_rating >= 4.0 then 1.0 else 0.0 end) * 100 as pct_ge_4
  from ratings where product_id is not null group by product_id""", ("ratings",))
add_view_sql("overall", """select avg_rating, total_negative, total_volume,
  total_negative / total_volume * 100 as avg_neg_rate
  from (select avg(predicted_rating) as avg_rating from ratings) a,
       (select cast(sum(negative) as bigint) as total_negative,
               cast(greatest(coalesce(sum(total_volume), 0), 1) as bigint) as total_volume
        from cube) b""", ("ratings", "cube"))
add_view_sql("spike_days", """select date, total_volume from daily,
  (select avg(total_volume) as m, stddev_samp(total_volume) as s from daily) st
  where total_volume > m + 1.5 * coalesce(s, 0)""", ("daily",))
add_view_sql("spam_daily", """select date, count(*) as spam_volume from mails
  where is_spam and date is not null group by date""", ("mails",))
add_view_sql("lshare", """select label, n, round(n / sum(n) over () * 100, 1) as pct,
  row_number() over (order by n desc, label) = 1 as is_top
  from (select label, count(*) as n from mails where label is not null group by label) c""", ("mails",))


@register("daily_volume", with_views("select * from daily", "daily"))
def q_daily_volume(spark, sf):
    return K.daily_volume(cube(spark, sf))


@register("spikes", with_views("select date, total_volume, 'High Volume Spike' as note from spike_days",
                               "spike_days"))
def q_spikes(spark, sf):
    return K.spikes(K.daily_volume(cube(spark, sf)))


@register("spikes_desc", with_views("select date, total_volume, 'High Volume Spike' as note from spike_days",
                                    "spike_days"))
def q_spikes_desc(spark, sf):
    return K.spikes(K.daily_volume(cube(spark, sf)), descending=True)


@register("topic_stats", with_views(
    "select topic, negative, total_volume, positive, round(neg_rate, 6) as neg_rate, "
    "round(severity, 6) as severity from tstats", "tstats"))
def q_topic_stats(spark, sf):
    return round_doubles(K.topic_stats(cube(spark, sf)))


@register("top_negative", with_views(
    "select topic, negative, total_volume, positive, round(neg_rate, 6) as neg_rate, "
    "round(severity, 6) as severity from tstats order by neg_rate desc, topic limit 10", "tstats"))
def q_top_negative(spark, sf):
    return round_doubles(K.top_negative(K.topic_stats(cube(spark, sf))))


@register("top_negative_5", with_views(
    "select topic, negative, total_volume, positive, round(neg_rate, 6) as neg_rate, "
    "round(severity, 6) as severity from tstats order by neg_rate desc, topic limit 5", "tstats"))
def q_top_negative_5(spark, sf):
    return round_doubles(K.top_negative(K.topic_stats(cube(spark, sf)), 5))


@register("topic_growth", with_views(
    "select topic, growth, round(growth_pct, 6) as growth_pct from growth "
    "order by growth_pct desc, topic limit 5", "growth"))
def q_topic_growth(spark, sf):
    return round_doubles(K.topic_growth(cube(spark, sf)))


@register("product_stats", with_views(
    "select product_id, round(avg_rating, 6) as avg_rating, review_count, round(rating_std, 6) as rating_std, "
    "round(pct_ge_4, 6) as pct_ge_4 from pstats", "pstats"))
def q_product_stats(spark, sf):
    return round_doubles(K.product_stats(ratings(spark, sf)))


@register("risky_products", with_views(
    "select product_id, round(avg_rating, 6) as avg_rating, review_count, round(rating_std, 6) as rating_std, "
    "round(pct_ge_4, 6) as pct_ge_4 from pstats where avg_rating < 3.5", "pstats"))
def q_risky_products(spark, sf):
    return round_doubles(K.risky_products(K.product_stats(ratings(spark, sf))))


@register("weekly_drift", with_views(
    """with w as (select *, date_trunc('week', date) as wk from ratings where date is not null),
       two as (select max(wk) as w1, max(wk) filter (where wk < (select max(wk) from w)) as w0 from w)
    select product_id, round(case when l is not null and p is not null and p <> 0
                                  then (l - p) / p * 100 else 0.0 end, 6) as drift_pct
    from (select product_id, avg(predicted_rating) filter (where wk = w1) as l,
                 avg(predicted_rating) filter (where wk = w0) as p
          from w, two where w0 is not null group by product_id) g""", "ratings"))
def q_weekly_drift(spark, sf):
    return round_doubles(K.weekly_drift(ratings(spark, sf)))


@register("describe_ratings", with_views(
    """select count(predicted_rating) as rating_count, round(avg(predicted_rating), 6) as rating_mean,
       round(stddev_samp(predicted_rating), 6) as rating_std, min(predicted_rating) as rating_min,
       round(quantile_cont(predicted_rating, 0.25), 6) as rating_q25,
       round(quantile_cont(predicted_rating, 0.5), 6) as rating_q50,
       round(quantile_cont(predicted_rating, 0.75), 6) as rating_q75, max(predicted_rating) as rating_max
    from ratings""", "ratings"))
def q_describe_ratings(spark, sf):
    return round_doubles(K.describe_ratings(ratings(spark, sf)))


@register("user_volatility", with_views(
    "select round(avg(s), 6) as user_volatility from (select user_id, stddev_samp(predicted_rating) as s "
    "from ratings group by user_id) u", "ratings"))
def q_user_volatility(spark, sf):
    return round_doubles(K.user_volatility(ratings(spark, sf)))


@register("rating_hist", with_views(
    """with d as (select predicted_rating as x from ratings where predicted_rating is not null and not isnan(predicted_rating)),
       mm as (select min(x) as lo0, max(x) as hi0 from d),
       r as (select case when lo0 = hi0 then lo0 - 0.5 else lo0 end as lo,
                    case when lo0 = hi0 then hi0 + 0.5 else hi0 end as hi from mm),
       c as (select cast(least(floor((x - lo) * (20.0 / (hi - lo))), 19) as int) as bin, count(*) as n
             from d, r group by 1)
    select g.bin, round(lo + g.bin * ((hi - lo) / 20.0), 6) as lower,
           round(lo + (g.bin + 1) * ((hi - lo) / 20.0), 6) as upper, coalesce(n, 0) as count
    from (select cast(i as int) as bin from range(0, 20) t(i)) g cross join r left join c on g.bin = c.bin""",
    "ratings"))
def q_rating_hist(spark, sf):
    return round_doubles(K.rating_hist(ratings(spark, sf)))


@register("rating_kde", with_views(
    """with d as (select predicted_rating as x from ratings where predicted_rating is not null),
       st as (select count(*) as n, stddev_samp(x) * pow(cast(count(*) as double), -0.2) as h,
                     min(x) as lo, max(x) as hi from d),
       g as (select n, h, lo - 3.0 * h as g0, hi + 3.0 * h as g1,
                    ((hi + 3.0 * h) - (lo - 3.0 * h)) / 199.0 as step from st),
       vc as (select x, count(*) as c from d group by x),
       pts as (select cast(i as int) as i, case when i = 199 then g1 else g0 + i * step end as gx, n, h
               from range(0, 200) t(i), g)
    select i as point, round(gx, 6) as x,
           round(sum(c * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * sqrt(2 * pi())), 6) as density
    from pts, vc group by i, gx, n, h""", "ratings"))
def q_rating_kde(spark, sf):
    return round_doubles(K.rating_kde(ratings(spark, sf)))


@register("spam_rate", with_views(
    """select count(*) as total_emails, count(*) filter (where is_spam) as spam_count,
       round(case when count(*) > 0 then count(*) filter (where is_spam) / count(*) * 100 else 0.0 end, 6)
         as spam_rate from mails""", "mails"))
def q_spam_rate(spark, sf):
    return round_doubles(K.spam_rate(mails(spark, sf)))


@register("spam_daily", with_views("select * from spam_daily", "spam_daily"))
def q_spam_daily(spark, sf):
    return K.spam_daily(mails(spark, sf))


@register("spam_spikes", with_views(
    """select date, spam_volume, 'High Spam Volume Spike' as note from spam_daily,
       (select avg(spam_volume) as m, stddev_samp(spam_volume) as s from spam_daily) st
       where spam_volume > m + 1.5 * coalesce(s, 0)""", "spam_daily"))
def q_spam_spikes(spark, sf):
    return K.spam_spikes(mails(spark, sf))


@register("label_share", with_views("select * from lshare", "lshare"))
def q_label_share(spark, sf):
    return K.label_share(mails(spark, sf))


@register("top_n_others", with_views(
    """with r as (select label, cast(pct as double) as pct, row_number() over (order by pct desc, label) as rk
                 from lshare)
    select label, round(pct, 6) as pct from r where rk <= 5
    union all
    select 'Others' as label, round(sum(pct), 6) as pct from r where rk > 5 having sum(pct) > 0""", "lshare"))
def q_top_n_others(spark, sf):
    return round_doubles(K.top_n_others(K.label_share(mails(spark, sf))))


@register("email_daily", with_views(
    "select date, count(*) as count from mails where date is not null group by date", "mails"))
def q_email_daily(spark, sf):
    return K.email_daily(mails(spark, sf))


@register("email_label_counts", with_views(
    "select label, count(*) as count from mails group by label", "mails"))
def q_email_label_counts(spark, sf):
    return K.label_counts(mails(spark, sf))


@register("complaint_count", with_views(
    "select count(*) filter (where lower(label) = 'complaint') as label_count, "
    "count(*) filter (where lower(label) = 'complaint') > 0 as present from mails", "mails"))
def q_complaint_count(spark, sf):
    return K.count_label(mails(spark, sf), "complaint")


@register("overall_kpis", with_views(
    "select round(avg_rating, 6) as avg_rating, total_negative, total_volume, "
    "round(avg_neg_rate, 6) as avg_neg_rate from overall", "overall"))
def q_overall(spark, sf):
    return round_doubles(K.overall(ratings(spark, sf), cube(spark, sf)))


_INSIGHTS_SQL = """
select 'avg_rating' as rule, 'info' as severity, 'mean rating ' || printf('%.2f', avg_rating) || '/5' as message from overall
union all select 'neg_rate', 'info', 'mean negative rate ' || printf('%.1f', avg_neg_rate) || '%' from overall
union all select 'volume', 'info', 'total volume ' || cast(cast(total_volume as bigint) as varchar) from overall
union all select 'polarisation', 'warning', 'high rating but much negative discussion' from overall
  where avg_rating > 4.0 and avg_neg_rate > 30
union all select 'crisis', 'critical', 'low rating and strongly negative discussion' from overall
  where avg_rating < 3.0 and avg_neg_rate > 50
union all select 'spike', 'warning', 'volume spike on ' || string_agg(strftime(date, '%Y-%m-%d'), ', ' order by strftime(date, '%Y-%m-%d'))
  from spike_days having count(*) > 0
union all (select 'worst_topic', 'warning', 'most negative topic ' || topic || ' (' || printf('%.1f', neg_rate) || '%)'
  from tstats order by neg_rate desc, topic limit 1)
union all select 'risky_products', 'critical', 'products to check: ' || string_agg(product_id, ', ' order by avg_rating, product_id)
  from (select * from pstats where avg_rating < 3.5 order by avg_rating, product_id limit 5) r having count(*) > 0
union all (select 'growth', 'info', 'fastest growing topic ' || topic || ' (' || printf('%.1f', growth_pct) || '%)'
  from growth order by growth_pct desc, topic limit 1)
union all select 'spam_rate', 'info', 'spam share ' || printf('%.1f', case when count(*) > 0
  then count(*) filter (where is_spam) / count(*) * 100 else 0.0 end) || '%' from mails
union all select 'top_label', 'info', 'most frequent label ' || label || ' (' || printf('%.1f', pct) || '%)'
  from lshare where is_top
"""


@register("insights", with_views(_INSIGHTS_SQL, "overall", "spike_days", "tstats", "pstats", "growth",
                                 "mails", "lshare"))
def q_insights(spark, sf):
    return K.insights(ratings(spark, sf), cube(spark, sf), mails(spark, sf))


@register("sentiment_stats", with_views(
    """select count(*) as total, count(*) filter (where sentiment = 'Negative') as negative,
       count(*) filter (where sentiment = 'Positive') as positive,
       count(*) filter (where sentiment = 'Neutral') as neutral,
       round(case when count(*) > 0 then count(*) filter (where sentiment = 'Negative') / count(*) * 100
             else 0.0 end, 6) as negative_pct
    from feedback where date >= date '2024-01-08' and date <= date '2024-01-21' and topic = 'purchase'""",
    "feedback"))
def q_sentiment_stats(spark, sf):
    return round_doubles(K.sentiment_stats(feedback(spark, sf), "2024-01-08", "2024-01-21", "purchase"))


@register("top_negative_reviews", with_views(
    "select * from feedback where lower(sentiment) = 'negative' order by value, id limit 10", "feedback"))
def q_top_negative_reviews(spark, sf):
    return K.top_negative_reviews(feedback(spark, sf), 10, score="value", ascending=True)


@register("top_sources_others", """with c as (select source as label, count(*) as n from documents where source is not null group by 1),
      s as (select label, round(n / (select sum(n) from c) * 100, 1) as pct from c),
      r as (select label, cast(pct as double) as pct, row_number() over (order by pct desc, label) as rk from s)
    select label, round(pct, 6) as pct from r where rk <= 5
    union all select 'Others', round(sum(pct), 6) from r where rk > 5 having sum(pct) > 0""")
def q_top_sources_others(spark, sf):
    """H16 over more labels than are shown: 15 of 20 sources are summed into Others."""
    d = table(spark, sf, "documents").select(F.col("source").alias("label"))
    return round_doubles(K.top_n_others(K.label_share(d)))


@register("insights_stable", with_views(
    """select 'stable' as rule, count(*) = 0 as holds from (select avg(rating) as a from interactions) x,
       (select count(*) filter (where sentiment = 'Negative') * 100.0 / count(*) as n from feedback) y
       where (a > 4 and n > 30) or (a < 3 and n > 50)""", "interactions", "feedback"))
def q_insights_stable(spark, sf):
    """H19 with the stable rule: it is there exactly if neither polarisation nor crisis is."""
    out = K.insights(ratings(spark, sf), cube(spark, sf), with_stable=True)
    return out.agg(F.lit("stable").alias("rule"), (F.count_if(F.col("rule") == "stable") == 1).alias("holds")).select("rule", "holds")
