"""Daily trend roll-up.

Scored comments -> counts per (day, topic, sentiment) -> sentiments as columns
-> total volume and negative rate. ``trend_daily`` fuses the steps into one
aggregate: conditional counts with map-side partial aggregation, so the only
shuffle carries one partial row per (day, topic) per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three sentiment columns of the trend cube, in this order.
SENTIMENTS = ("Negative", "Positive", "Neutral")


def _day(c: str) -> Column:
    return F.to_date(F.col(c))


def volume_by_day(df: DataFrame, ts: str = "date", topic: str = "topic",
                  sentiment: str = "sentiment") -> DataFrame:
    """G1: rows per (day, topic, sentiment) as ``volume``."""
    return (df.where(F.col(ts).isNotNull())
              .groupBy(_day(ts).alias("date"), F.col(topic).alias("topic"),
                       F.col(sentiment).alias("sentiment"))
              .agg(F.count(F.lit(1)).alias("volume")))


def pivot_sentiment(vol: DataFrame, sentiments: Sequence[str] = SENTIMENTS) -> DataFrame:
    """Sentiments to columns, missing -> 0. Unknown sentiments are dropped (Q12)."""
    p = (vol.groupBy("date", "topic")
            .pivot("sentiment", list(sentiments))
            .agg(F.sum("volume")))
    return p.select("date", "topic", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s)
                                       for s in sentiments])


def trend_rates(p: DataFrame, round_to: int | None = None,
                sentiments: Sequence[str] = SENTIMENTS) -> DataFrame:
    """``total_volume`` over the known sentiments and ``negative_rate`` (0 when empty)."""
    total = sum((F.col(s) for s in sentiments[1:]), F.col(sentiments[0]))
    p = p.withColumn("total_volume", total)
    rate = F.col("Negative") / F.col("total_volume")
    if round_to is not None:
        rate = F.round(rate, round_to)
    return p.withColumn("negative_rate",
                        F.when(F.col("total_volume") > 0, rate).otherwise(F.lit(0.0)))


def trend_daily(df: DataFrame, ts: str = "date", topic: str = "topic",
                sentiment: str = "sentiment", round_to: int | None = None) -> DataFrame:
    """G1-G3 in one aggregate: the flagship daily trend cube."""
    counts = [F.count_if(F.col(sentiment) == s).alias(s) for s in SENTIMENTS]
    p = (df.where(F.col(ts).isNotNull())
           .groupBy(_day(ts).alias("date"), F.col(topic).alias("topic"))
           .agg(*counts))
    return trend_rates(p, round_to)


def trend_text_dates(cube: DataFrame) -> DataFrame:
    """The date as ``yyyy-MM-dd`` text, as the API returns it."""
    return cube.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def trend_summary(scored: DataFrame, cube: DataFrame, ts: str = "date") -> DataFrame:
    """G4 summary: records with a valid date, rows and distinct days of the cube.

    Both inputs are tagged and unioned so one aggregate answers all three.
    """
    a = scored.where(F.col(ts).isNotNull()).select(
        F.lit(1).alias("rec"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("date").alias("day"))
    b = cube.select(F.lit(None).cast("int").alias("rec"), F.lit(1).alias("row"), F.col("date").cast("date").alias("day"))
    return a.unionByName(b).agg(F.count("rec").alias("total_records"),
                                F.count("row").alias("total_rows"),
                                F.countDistinct("day").alias("total_days"))


def trend_report(raw: DataFrame, topic_model=None, sentiment_model=None, round_to: int | None = 2, feed_model=None):
    """The trend upload: resolve date/text columns, lenient UTC dates, clean, score (a two-headed
    pipeline, two models or keyword rules), roll up per day and topic. Returns (cube with text dates, summary)."""
    from feedpulse.operators.scoring import prepare_feed, score_feed
    scored = score_feed(prepare_feed(raw), topic_model, sentiment_model, feed_model=feed_model)
    cube = trend_daily(scored, round_to=round_to)
    return trend_text_dates(cube), trend_summary(scored, cube)
