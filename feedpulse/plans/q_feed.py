"""Registered queries of one feed scored by two fitted heads, in batch (F6) and as a stream (K6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedpulse.functions import text as X
from feedpulse.operators import nightly as N
from feedpulse.operators import scoring as SC
from feedpulse.operators import train as TR
from feedpulse.plans.registry import register
from feedpulse.plans.views import day_from_no, texts
from feedpulse.session import scratch_path, written
from feedpulse.sources.tables import table
from feedpulse.streaming import streams as K

FEED_SPEC = TR.TextModelSpec(text_col="clean_text", max_features=TR.TOPIC_TERMS)
DROP_GROUP = 4 << 20  # bytes of a row group in the files of a drop


def feed_rows(spark, sf):
    """Every document with its date, cleaned text and topic, and its sentiment where it is labelled."""
    lab = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("sentiment"))
    d = texts(spark, sf).select("doc_id", day_from_no(F.col("day_no")).alias("date"), X.clean_trend(X.null_text("text", "nan")).alias("clean_text"), "topic")
    return d.join(lab, "doc_id", "left")


def cleaned_rows(spark, sf):
    """``feed_rows`` written once, for a query that fits and scores them."""
    return written(feed_rows(spark, sf), "feed-rows")


def _fitted(rows, terms: int = TR.TOPIC_TERMS, max_iter: int = 20):
    return TR.train_feed(rows, _spec(terms), max_iter=max_iter)


def _spec(terms: int = TR.TOPIC_TERMS) -> TR.TextModelSpec:
    return TR.TextModelSpec(text_col="clean_text", max_features=terms)


def _scored(rows, model):
    return SC.score_two_heads(rows.select("doc_id", "date", "clean_text"), model)


@register("feed_model_scores")
def q_feed_model_scores(spark, sf):
    """all documents scored by both heads in one pass."""
    rows = cleaned_rows(spark, sf)
    return _scored(rows, _fitted(rows)).drop("clean_text")


@register("feed_model_exact", """select doc_id, true as topic_known, true as sentiment_known, true as in_range, true as reload_equal
    from documents""")
def q_feed_model_exact(spark, sf):
    """F6, what is exact of it: a row for each document, known labels, confidences in range, and the
    saved and reloaded pipeline gives the same row."""
    rows = cleaned_rows(spark, sf)
    model = _fitted(rows)
    root = scratch_path(spark, f"feed/{uuid.uuid4().hex[:12]}")
    N.save_version(spark, root, "feed", model, 1)
    a = _scored(rows, model)
    again = _scored(rows, N.load_current(spark, root, "feed")).drop("date", "clean_text")
    b = again.select("doc_id", F.struct(*[c for c in again.columns if c != "doc_id"]).alias("again"))
    topics = table(spark, sf, "documents").select(F.col("source").alias("topic"), F.lit(True).alias("known")).distinct()
    same = [F.col(c).eqNullSafe(F.col("again")[c]) for c in again.columns if c != "doc_id"]
    both = F.lit(True)
    for c in same:
        both = both & c
    ok = (F.col("topic_confidence").between(0, 1)) & (F.col("sentiment_confidence").between(0.5, 1))
    return a.join(b, "doc_id").join(topics, "topic", "left").select(
        "doc_id", F.coalesce("known", F.lit(False)).alias("topic_known"), F.col("sentiment").isin("Negative", "Positive").alias("sentiment_known"),
        ok.alias("in_range"), both.alias("reload_equal"))


@register("feed_model_trend_volume", """select date '2024-01-01' + cast(doc_id % 30 as int) as date, count(*) as total_volume,
    true as rates_ok from documents group by 1""")
def q_feed_model_trend(spark, sf):
    """F6 into G1-G4: the trend upload with the fitted heads; a day's volume is what was uploaded for it."""
    from feedpulse.operators.trend import trend_report
    rows = cleaned_rows(spark, sf)
    raw = rows.select(F.date_format("date", "yyyy-MM-dd'T'10:00:00'Z'").alias("created_at"), F.col("clean_text").alias("comment"))
    cube, _ = trend_report(raw, feed_model=_fitted(rows))
    ok = (F.col("Negative") + F.col("Positive") + F.col("Neutral") == F.col("total_volume")) & F.col("negative_rate").between(0, 1)
    return cube.groupBy(F.col("date").cast("date").alias("date")).agg(F.sum("total_volume").alias("total_volume"), F.bool_and(ok).alias("rates_ok"))


def drop(rows, path):
    """Files of many small row groups: a micro-batch takes few files, and all cores take part in it."""
    rows.write.mode("append").option("parquet.block.size", DROP_GROUP).parquet(path)


@register("stream_model_scores", "select doc_id, true as same, cast(1 as bigint) as version from documents")
def q_stream_model_scores(spark, sf):
    """K6: the feed arrives in four drops. After two, the stream stops, the alias moves to another
    version, and the stream goes on from its checkpoint: every row equals the batch scores of the version
    that the stream was started with, and no document is missing or written twice."""
    base = scratch_path(spark, f"stream/feed/{uuid.uuid4().hex[:12]}")
    labelled = cleaned_rows(spark, sf)
    rows = labelled.select("doc_id", "date", "clean_text")
    tokens = TR.tokenise(labelled, _spec(), ["topic", "sentiment"], again=True)  # two models are fitted on them
    first = _fitted(tokens)
    N.save_version(spark, base, "feed", first, 1)
    drops = rows.withColumn("drop", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    for part in (0, 2):
        drop(drops.where(F.col("drop").between(part, part + 1)).drop("drop"), f"{base}/in")
        src = K.stream_feed(spark, f"{base}/in", "doc_id bigint, date date, clean_text string", max_files=2)
        version = K.score_available(src, base, "feed", f"{base}/out", f"{base}/ckpt")
        if part == 0:
            N.save_version(spark, base, "feed", _fitted(tokens, 500, 5), 2)
    got = spark.read.parquet(f"{base}/out").drop("batch_id")
    want = SC.score_two_heads(rows, first)
    cols = [c for c in want.columns if c not in ("doc_id", "clean_text")]
    want = want.select("doc_id", F.struct(*cols).alias("want"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col("want")[c])
    return got.join(want, "doc_id", "full").select("doc_id", F.coalesce(same & F.col("want").isNotNull(), F.lit(False)).alias("same"),
                                                   F.lit(version).cast("long").alias("version"))
