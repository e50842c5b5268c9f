"""Streaming equals batch; models learn; plans keep the work distributed."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from feedpulse.operators import alerts as A
from feedpulse.operators import evaluate as E
from feedpulse.operators import train as TR
from feedpulse.operators.trend import trend_daily
from feedpulse.plans.registry import QUERIES, load_all
from feedpulse.plans.views import feedback
from feedpulse.session import scratch_path
from feedpulse.streaming import streams as K

from paths import SF_SMALL

load_all()


def _dirs(spark):
    b = scratch_path(spark, f"tests/{uuid.uuid4().hex}")
    return f"{b}/out", f"{b}/ckpt", b


def test_stream_trend_equals_batch(spark):
    s = QUERIES["stream_trend_daily"](spark, SF_SMALL)
    b = trend_daily(feedback(spark, SF_SMALL))
    key = ["date", "topic", "Negative", "Positive", "Neutral", "total_volume"]
    assert sorted(map(tuple, s.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))


def test_late_rows_dropped_by_watermark(spark):
    out, ck, base = _dirs(spark)
    src = f"{base}/in"
    mk = lambda rows: spark.createDataFrame(rows, "ts timestamp, topic string, sentiment string")
    mk([(dt.datetime(2024, 1, 10, 12), "a", "Negative")]).write.mode("append").parquet(src)
    q1 = K.stream_trend(K.stream_feed(spark, src, "ts timestamp, topic string, sentiment string"),
                        late_delay="1 hour")
    K.run_available(q1, out, ck)
    # second file: far newer row moves the watermark; an out-of-order row for day 10 arrives with it
    mk([(dt.datetime(2024, 1, 12, 12), "a", "Positive"), (dt.datetime(2024, 1, 10, 13), "a", "Negative")]) \
        .write.mode("append").parquet(src)
    K.run_available(q1, out, ck)
    # third file, a later run: the watermark is past day 10, so its day-10 row is late
    mk([(dt.datetime(2024, 1, 14, 12), "a", "Positive"), (dt.datetime(2024, 1, 10, 14), "a", "Negative")]) \
        .write.mode("append").parquet(src)
    res = K.run_available(q1, out, ck)
    day10 = res.where(F.col("date") == dt.date(2024, 1, 10)).collect()
    assert len(day10) == 1
    # the row arriving after the watermark passed day 10 is not counted
    assert day10[0]["Negative"] == 2


def test_stream_alert_hold_equals_batch(spark):
    s = QUERIES["stream_alert_hold"](spark, SF_SMALL)
    from feedpulse.plans.q_alerts import alert_table
    b = alert_table(spark, SF_SMALL).where(F.col("severity") == "warning") \
        .select(F.col("event_type").alias("series"), "t", "state", "active_since")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_modified_huber_loss_falls(spark):
    rows = [(i, j, 1.0) for i in range(40) for j in ([0] if i % 2 else [1])]
    x = spark.createDataFrame(rows, "doc_id long, idx int, weight double")
    y = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    w, b, hist = TR.train_modified_huber(x, y, max_epochs=15)
    assert hist[-1][1] < hist[0][1]
    scored = TR.score_linear(x, w, b).join(y, "doc_id")
    acc = E.accuracy(scored.select(F.col("prediction").alias("prediction"), F.col("y").alias("label"))).first()[0]
    assert acc == 1.0


def test_logistic_pipeline_beats_majority_and_round_trips(spark):
    rows = [(i, ("great good fine " if i % 2 else "awful bad poor ") + f"w{i}", "positive" if i % 2 else "negative")
            for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    m = TR.train_logistic(df, TR.TextModelSpec(max_features=50), max_iter=50)
    path = scratch_path(spark, f"tests/model-{uuid.uuid4().hex}")
    TR.save_model(m, path)
    from feedpulse.operators.scoring import score_sentiment
    out = score_sentiment(df, TR.load_model(path))
    acc = out.select((F.col("sentiment") == F.when(F.col("label") == "positive", "tích cực")
                      .otherwise("tiêu cực")).cast("double").alias("ok")).agg(F.avg("ok")).first()[0]
    assert acc > 0.9
    assert out.where((F.col("confidence") < 0.5) | (F.col("confidence") > 1)).count() == 0


def test_promotion_and_alias_log(spark):
    root = scratch_path(spark, f"tests/runs-{uuid.uuid4().hex}")
    E.set_alias(spark, root, "sentiment", 1)
    E.set_alias(spark, root, "sentiment", 3)
    E.set_alias(spark, root, "topic", 2)
    cur = {r["model"]: r["version"] for r in E.current_model(spark.read.parquet(f"{root}/aliases")).collect()}
    assert cur == {"sentiment": 3, "topic": 2}
    m = spark.createDataFrame([("email", "accuracy", 0.65), ("rating", "rmse", 1.5)], "model string, metric string, value double")
    got = {r["model"]: r["promote"] for r in E.promote(m, E.rules_frame(spark)).collect()}
    assert got == {"email": False, "rating": True}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["trend_daily", "topic_growth", "weekly_drift", "split_stratified", "apply_index",
                                  "increase_1h", "histogram_quantile_p95", "alert_states", "alert_routes",
                                  "alert_inhibit", "tfidf", "insights", "rating_kde"])
def test_no_cartesian_or_python_rows(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_and_projection_reach_the_scan(spark):
    df = QUERIES["sentiment_stats"](spark, SF_SMALL)
    plan = _plan(df)
    # the date range on cast(ts as date) is rewritten to a range on ts and pushed to Parquet
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(event_type), GreaterThanOrEqual(ts,2024-01-08T00:00)" in plan
    assert "EqualTo(event_type,purchase)" in df._jdf.queryExecution().executedPlan().toString() or "purchase" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_stream_hold_matches_batch_on_gaps(spark):
    out, ck, base = _dirs(spark)
    step = 60
    vals = [(0, 5.0), (60, 5.0), (120, 5.0), (240, 5.0), (300, 5.0), (360, 5.0), (420, 1.0), (480, 5.0)]
    got = set()
    for part in range(3):  # three arrivals, in time order, each its own micro-batch
        rows = [("s", t, v) for t, v in vals if t // 180 == part]
        spark.createDataFrame(rows, "k string, t long, value double").coalesce(1).write.mode("append") \
            .parquet(f"{base}/in")
        src = spark.readStream.schema("k string, t long, value double").parquet(f"{base}/in")
        got = {tuple(r) for r in K.run_available(K.stream_alerts(src, "k", 2.0, 120, step), out, ck).collect()}
    e = spark.createDataFrame([("s", t, v) for t, v in vals], "k string, t long, value double")
    want = {(r["k"], r["t"], r["state"], r["active_since"])
            for r in A.alerts(e, ["k"], "value", ">", 2.0, 120, step, "X").collect()}
    # the stream cannot know the data ended; the batch closes the last run only if it fired
    assert got == want


def test_linear_text_model_learns_and_round_trips(spark):
    rows = [(i, ("win free money prize now " if i % 3 == 0 else "meeting agenda notes team ") + f"w{i}", int(i % 3 == 0))
            for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    spec = TR.TextModelSpec(text_col="text", label_col="y", doc_col="doc_id", max_features=50, grams=2)
    m = TR.train_linear(df, spec, loss="modified_huber", max_iter=20, valid_frac=None)
    acc = m.transform(df).select((F.col("prediction") == F.col("y")).cast("double").alias("ok")).agg(F.avg("ok")).first()[0]
    assert acc == 1.0
    path = scratch_path(spark, f"tests/linear-{uuid.uuid4().hex}")
    m.save(path)
    back = TR.LinearTextModel.load(spark, path)
    a = sorted(map(tuple, m.transform(df).select("doc_id", "prediction").collect()))
    b = sorted(map(tuple, back.transform(df).select("doc_id", "prediction").collect()))
    assert a == b
    _, metrics = TR.train_epochs(df, df, spec, epochs=3)
    steps = sorted(r["step"] for r in metrics.where(F.col("key") == "weighted_f1").collect())
    assert steps == [1, 2, 3]


def test_event_time_hold_orders_late_instants(spark):
    out, ck, base = _dirs(spark)
    step = 60
    vals = [(0, 5.0), (60, 5.0), (120, 5.0), (240, 5.0), (300, 5.0), (360, 5.0), (420, 1.0), (480, 5.0)]
    base_t = 1_704_067_200  # 2024-01-01: the first watermark is epoch 0, so toy times near 0 would be late
    vals = [(base_t + t, v) for t, v in vals]
    arrivals = [[240, 300], [0, 60, 120], [360, 420, 480], [10000]]  # out of order, then a later instant
    arrivals = [[base_t + t for t in a] for a in arrivals]
    allv = dict(vals + [(base_t + 10000, 0.0)])
    got = set()
    for times in arrivals:
        spark.createDataFrame([("s", t, allv[t]) for t in times], "k string, t long, value double").coalesce(1) \
            .write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema("k string, t long, value double").parquet(f"{base}/in")
        res = K.run_available(K.stream_alerts(src, "k", 2.0, 120, step, late_delay="10 minutes"), out, ck)
        got = {tuple(r) for r in res.collect()}
    e = spark.createDataFrame([("s", t, v) for t, v in allv.items()], "k string, t long, value double")
    want = {(r["k"], r["t"], r["state"], r["active_since"])
            for r in A.alerts(e, ["k"], "value", ">", 2.0, 120, step, "X").collect()}
    assert got == want


def test_update_mode_gold_rewrites_changed_partitions(spark):
    out, ck, base = _dirs(spark)
    schema = "ts timestamp, topic string, sentiment string"
    first = [(dt.datetime(2024, 1, 1, 9), "a", "Negative"), (dt.datetime(2024, 1, 1, 10), "b", "Positive")]
    second = [(dt.datetime(2024, 1, 1, 11), "a", "Positive"), (dt.datetime(2024, 1, 2, 9), "a", "Neutral")]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        K.run_update_to_gold(K.stream_trend(K.stream_feed(spark, f"{base}/in", schema)), out, ck)
    got = {(r["date"], r["topic"]): (r["Negative"], r["Positive"], r["Neutral"]) for r in spark.read.parquet(out).collect()}
    assert got == {(dt.date(2024, 1, 1), "a"): (1, 1, 0), (dt.date(2024, 1, 1), "b"): (0, 1, 0),
                   (dt.date(2024, 1, 2), "a"): (0, 0, 1)}
