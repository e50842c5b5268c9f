"""Registered trend queries."""

from __future__ import annotations


from feedpulse.operators import trend as T
from feedpulse.plans.registry import register
from feedpulse.plans.views import feedback, with_views

_CUBE_SQL = """select date, topic,
  count(*) filter (where sentiment = 'Negative') as Negative,
  count(*) filter (where sentiment = 'Positive') as Positive,
  count(*) filter (where sentiment = 'Neutral') as Neutral,
  count(*) filter (where sentiment in ('Negative','Positive','Neutral')) as total_volume,
  case when count(*) filter (where sentiment in ('Negative','Positive','Neutral')) > 0
       then count(*) filter (where sentiment = 'Negative')
            / count(*) filter (where sentiment in ('Negative','Positive','Neutral'))
       else 0.0 end as negative_rate
from feedback where date is not null group by date, topic"""


@register("trend_daily", with_views(_CUBE_SQL, "feedback"))
def trend_daily(spark, sf):
    return T.trend_daily(feedback(spark, sf))


@register("volume_by_day", with_views(
    "select date, topic, sentiment, count(*) as volume from feedback "
    "where date is not null group by date, topic, sentiment", "feedback"))
def volume_by_day(spark, sf):
    return T.volume_by_day(feedback(spark, sf))


@register("pivot_sentiment", with_views(
    """select date, topic,
      cast(coalesce(sum(volume) filter (where sentiment = 'Negative'), 0) as bigint) as Negative,
      cast(coalesce(sum(volume) filter (where sentiment = 'Positive'), 0) as bigint) as Positive,
      cast(coalesce(sum(volume) filter (where sentiment = 'Neutral'), 0) as bigint) as Neutral
    from (select date, topic, sentiment, count(*) as volume from feedback
          where date is not null group by 1, 2, 3) group by date, topic""", "feedback"))
def pivot_sentiment(spark, sf):
    return T.pivot_sentiment(T.volume_by_day(feedback(spark, sf)))


@register("trend_rates_api", with_views(
    """select date, topic, Negative, Positive, Neutral, total_volume,
       case when total_volume > 0 then round(Negative / total_volume, 2) else 0.0 end as negative_rate
    from (select date, topic,
            count(*) filter (where sentiment = 'Negative') as Negative,
            count(*) filter (where sentiment = 'Positive') as Positive,
            count(*) filter (where sentiment = 'Neutral') as Neutral,
            count(*) filter (where sentiment in ('Negative','Positive','Neutral')) as total_volume
          from feedback where date is not null group by date, topic) c""", "feedback"))
def trend_rates_api(spark, sf):
    p = T.pivot_sentiment(T.volume_by_day(feedback(spark, sf)))
    return T.trend_rates(p, round_to=2)


@register("trend_text", with_views(
    "select strftime(date, '%Y-%m-%d') as date, topic, Negative, Positive, Neutral, total_volume, "
    "negative_rate from (" + _CUBE_SQL + ") c", "feedback"))
def trend_text(spark, sf):
    return T.trend_text_dates(T.trend_daily(feedback(spark, sf)))


@register("trend_summary", with_views(
    "select (select count(*) from feedback where date is not null) as total_records, "
    "count(*) as total_rows, count(distinct date) as total_days from (" + _CUBE_SQL + ") c", "feedback"))
def trend_summary(spark, sf):
    fb = feedback(spark, sf)
    return T.trend_summary(fb, T.trend_daily(fb))
