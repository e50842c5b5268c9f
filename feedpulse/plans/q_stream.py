"""Registered streaming queries (K1-K6): run to completion, compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedpulse.functions import text as X
from feedpulse.operators import timeseries as J
from feedpulse.plans import q_alerts  # noqa: F401  (declares the alerts oracle view)
from feedpulse.plans.q_text import sql_clean_trend
from feedpulse.plans.q_timeseries import KEYS, STEP, W, spark_samples
from feedpulse.plans.registry import register
from feedpulse.plans.views import DAY_ZERO, NEGATIVE_BELOW, POSITIVE_BELOW, with_views
from feedpulse.session import scratch_path
from feedpulse.sources.tables import table
from feedpulse.streaming import streams as K


def _run_dir(spark, name):
    # a fresh sink and checkpoint per run: the query re-reads the whole input
    base = scratch_path(spark, f"stream/{name}/{uuid.uuid4().hex[:12]}")
    return f"{base}/out", f"{base}/ckpt"


def event_stream(spark, sf):
    return K.stream_table(spark, sf, "events", K.EVENT_SCHEMA)


def _feedback_stream(spark, sf):
    e = event_stream(spark, sf)
    return e.select("event_id", "ts", F.col("event_type").alias("topic"),
                    F.when(F.col("value") < NEGATIVE_BELOW, "Negative").when(F.col("value") < POSITIVE_BELOW, "Positive")
                     .otherwise("Neutral").alias("sentiment"))


@register("stream_ingest", "select event_id, event_type, value from events")
def q_stream_ingest(spark, sf):
    out, ck = _run_dir(spark, "ingest")
    return K.run_available(event_stream(spark, sf).select("event_id", "event_type", "value"), out, ck)


_CUBE = """select date, topic,
  count(*) filter (where sentiment = 'Negative') as Negative,
  count(*) filter (where sentiment = 'Positive') as Positive,
  count(*) filter (where sentiment = 'Neutral') as Neutral, count(*) as total_volume,
  count(*) filter (where sentiment = 'Negative') / count(*) as negative_rate
  from feedback where date is not null group by date, topic"""


@register("stream_trend_daily", with_views(_CUBE, "feedback"))
def q_stream_trend(spark, sf):
    out, ck = _run_dir(spark, "trend")
    return K.run_available(K.stream_trend(_feedback_stream(spark, sf)), out, ck, mode="complete")


@register("stream_trend_watermarked", with_views(
    "select * from (" + _CUBE + ") c where cast(date + 1 as timestamp) <= "
    "(select max(ts) - interval 1 day from events)", "feedback"))
def q_stream_trend_append(spark, sf):
    """K4: append mode, 1 day lateness: only days closed by the watermark are emitted."""
    out, ck = _run_dir(spark, "trend_append")
    return K.run_available(K.stream_trend(_feedback_stream(spark, sf), late_delay="1 day"), out, ck, mode="append")


@register("stream_rates_5m", """select epoch_us(ts) // 15000000 * 15 - j * 15 as window_start, event_type, count(*) as n,
    count(*) / 300.0 as rate
    from events, range(0, 20) r(j) group by 1, 2""")
def q_stream_rates(spark, sf):
    """K3 in append mode, by panes of 15 s, closed at the end of the input: equal to batch for every window."""
    out, ck = _run_dir(spark, "rates")
    return K.rates_to_end(event_stream(spark, sf).select("ts", "event_type"), "event_type", out, ck)


SLICES = 5             # time slices of the alert input, each a file drop of its own
TICK = "__clock"       # the series whose rows only move the evaluation time on


@register("stream_alert_hold", with_views(
    "select event_type as series, severity, t, state, active_since from alerts", "alerts"))
def q_stream_alerts(spark, sf):
    """K5: the hold state machine of both rules over a file stream of 1 h increases, in event time.

    The input arrives as several micro-batches of time slices, their rows in any order. A run that
    is still live at the end resolves only at an evaluated instant, as in J13; a last row of a clock
    series moves the watermark to the last instant.
    """
    base = scratch_path(spark, f"stream/alert_input/{uuid.uuid4().hex[:12]}")
    inc = J.increase(spark_samples(spark, sf), KEYS, W, STEP)
    inc = inc.select(F.col("event_type"), "t", F.col("increase").alias("value")).checkpoint()
    lo, hi = inc.agg(F.min("t"), F.max("t")).first()
    span = -(-(hi - lo + 1) // SLICES)
    schema = "event_type string, t long, value double"
    for i in range(SLICES):  # one drop after the other, as an evaluation job writes them
        inc.where((F.col("t") >= lo + i * span) & (F.col("t") < lo + (i + 1) * span)).write.mode("append").parquet(base)
    delay = 2 * span  # the files of a slice may be read in several micro-batches
    spark.createDataFrame([(TICK, hi + delay, None)], schema).write.mode("append").parquet(base)
    parts = []
    for _, severity, threshold, hold in q_alerts.RULES:
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(base)
        out, ck = _run_dir(spark, f"alerts_{severity}")
        got = K.run_available(K.stream_alerts(src, "event_type", threshold, hold, STEP, late_delay=f"{delay} seconds"), out, ck)
        parts.append(got.where(F.col("series") != TICK).withColumn("severity", F.lit(severity)))
    return parts[0].unionByName(parts[1])


@register("stream_score_rules", f"""select cast(date '{DAY_ZERO}' + cast(d.doc_id % 30 as int) as date) as date,
       case when contains(c, 'pin') then 'Battery' when contains(c, 'ship') then 'Shipping' else 'Other' end as topic,
       count(*) as n
    from (select doc_id, {sql_clean_trend('text')} as c from documents) d
    group by 1, 2""")
def q_stream_score(spark, sf):
    docs = K.stream_table(spark, sf, "documents", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = docs.select(
        F.date_add(F.lit(DAY_ZERO).cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        X.clean_trend("text").alias("clean_text"))
    scored = K.stream_score(d)
    agg = scored.groupBy("date", "topic").agg(F.count(F.lit(1)).alias("n"))
    out, ck = _run_dir(spark, "score")
    return K.run_available(agg, out, ck, mode="complete")


@register("stream_csv_ingest", "select doc_id, text, lang, source, n_chars from documents")
def q_stream_csv(spark, sf):
    """K1 for the nightly CSV drops: documents written as CSV files, picked up by a file stream."""
    from feedpulse.sources import io as IO
    base = scratch_path(spark, f"stream/csv_input/{uuid.uuid4().hex[:12]}")
    IO.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), base)
    src = K.stream_feed(spark, base, "doc_id bigint, text string, lang string, source string, n_chars bigint",
                        glob="*.csv", fmt="csv")
    out, ck = _run_dir(spark, "csv_ingest")
    return K.run_available(src, out, ck)


@register("stream_trend_gold", with_views(_CUBE, "feedback"))
def q_stream_trend_gold(spark, sf):
    """K2 with the production sink: update mode, changed (day, topic) partitions rewritten."""
    out, ck = _run_dir(spark, "trend_gold")
    events = K.stream_table(spark, sf, "events", K.EVENT_SCHEMA, max_files=1)
    fb = events.select("ts", F.col("event_type").alias("topic"),
                       F.when(F.col("value") < NEGATIVE_BELOW, "Negative")
                        .when(F.col("value") < POSITIVE_BELOW, "Positive").otherwise("Neutral").alias("sentiment"))
    K.run_update_to_gold(K.stream_trend(fb), out, ck)
    return spark.read.parquet(out).select("date", "topic", "Negative", "Positive", "Neutral", "total_volume",
                                          "negative_rate")
