"""Small inputs of the documented shapes, run through the operators (hand-computed results)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from feedpulse.functions import schema as S
from feedpulse.functions import text as X
from feedpulse.operators import features as D
from feedpulse.operators import kpi as K
from feedpulse.operators import trend as T
from feedpulse.operators.scoring import prepare_feed, score_feed
from feedpulse.operators.split import split_stratified
from feedpulse.sources import io as IO

EMAILS = '''subject,text,label
"Winter raffle","You won a kettle, press HERE now","spam"
"Parcel","Where is my parcel?","support"
"Invoice 17","Your blue chair, 2 pcs, has left our shop","order"
"Pills","Buy cheap pills today","spam"
"Garden chair","One leg of the chair is bent","support"
'''
NEWS = '''text,label
"The river bank raises its rates","business"
"A new telescope sees a young star","tech"
"Harbour town wins the rowing cup","sports"
"Wheat prices fall for a third week","business"
"Small robots sort the autumn apples","tech"
"The marathon starts at the old mill","sports"
"Two shipyards become one company","business"
'''
INTERACTIONS = """user_id,product_id,rating
7,31,4
7,32,2
8,31,5
8,33,1
8,34,3
9,32,3
9,31,3
11,34,5
"""
# keywords of the rules: battery (pin), shipping (ship), negative (yếu)
TREND_COMMENTS = ["pin yếu", "chậm", "ship đúng hẹn", "loa nhỏ", "pin tốt", "ship yếu", "hộp đẹp", "pin", "màu xanh"]


def _folder(tmp_path, name, text):
    d = tmp_path / name
    d.mkdir()
    (d / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(d)


def test_email_sample_targets(spark, tmp_path):
    df = IO.read_csv_folder(spark, _folder(tmp_path, "emails", EMAILS), columns=["text", "label"])
    clean = df.select(X.clean_words(X.null_text("text")).alias("clean_text"), "label")
    strict = clean.select("clean_text", X.spam_target("label", "strict").alias("y")).dropna()
    assert sorted(r["y"] for r in strict.collect()) == [1, 1]          # support / order dropped (Q6)
    assert S.sufficient(strict.withColumnRenamed("y", "label"), "label").first()["sufficient"] is False
    ovr = clean.select(X.spam_target("label", "one_vs_rest").alias("y"))
    assert sorted(r["y"] for r in ovr.collect()) == [0, 0, 0, 1, 1]
    spam = sorted(r["clean_text"] for r in clean.where(F.col("label") == "spam").collect())
    assert spam == ["buy cheap pills today", "you won a kettle press here now"]


def test_news_sample_topic_alias_and_split(spark, tmp_path):
    raw = IO.read_csv_folder(spark, _folder(tmp_path, "news", NEWS))
    df = S.resolve(raw, {"text": ["text"], "topic": ["topic", "label"]})  # Q4
    counts = {r["label"]: r["count"] for r in S.label_counts(df, "topic").collect()}
    assert counts == {"business": 3, "tech": 2, "sports": 2}
    s = split_stratified(df.withColumn("id", F.xxhash64("text")), ["id"], "topic", 0.2, 42)
    per = {r["topic"]: r["n"] for r in s.where("is_test").groupBy("topic").agg(F.count("*").alias("n")).collect()}
    assert per == {"business": 1, "tech": 1, "sports": 1}


def test_interactions_sample_kpis(spark, tmp_path):
    raw = IO.read_csv_folder(spark, _folder(tmp_path, "inter", INTERACTIONS))
    from feedpulse.functions.schema import RECSYS_ALIASES, RECSYS_TEXT_DEFAULTS
    r = S.drop_null(S.resolve(raw, RECSYS_ALIASES, RECSYS_TEXT_DEFAULTS), ["user_id", "item_id", "rating"])
    assert r.count() == 8                                                 # product_id accepted (Q3)
    users = {x["user_id"]: x["idx"] for x in D.fit_index(r, "user_id").collect()}
    assert users == {"11": 0, "7": 1, "8": 2, "9": 3}                     # sorted as text
    rt = r.select(F.col("item_id").alias("product_id"), F.col("rating").cast("double").alias("predicted_rating"),
                  "user_id")
    stats = {x["product_id"]: x for x in K.product_stats(rt).collect()}
    assert stats["31"]["review_count"] == 3 and math.isclose(stats["31"]["avg_rating"], 4.0)
    assert [x["product_id"] for x in K.risky_products(K.product_stats(rt)).collect()] == ["33", "32"]
    # user 7: 4, 2; user 8: 5, 1, 3; user 9: 3, 3; user 11 has one rating
    vol = K.user_volatility(rt).first()[0]
    assert math.isclose(vol, (math.sqrt(2.0) + 2.0 + 0.0) / 3)
    d = K.describe_ratings(rt).first()
    assert (d["rating_count"], d["rating_min"], d["rating_q50"], d["rating_max"]) == (8, 1.0, 3.0, 5.0)


def test_trend_sample(spark):
    day0 = dt.datetime(2024, 5, 20, 9, 0)
    rows = [((day0 - dt.timedelta(days=i % 3)).strftime("%Y-%m-%dT%H:%M:%SZ"), c) for i, c in enumerate(TREND_COMMENTS)]
    raw = spark.createDataFrame(rows, "date string, comment string")
    cube = T.trend_daily(score_feed(prepare_feed(raw)))
    got = {(r["date"].day, r["topic"]): (r["Negative"], r["Positive"], r["total_volume"]) for r in cube.collect()}
    assert got == {(20, "Battery"): (1, 0, 1), (20, "Other"): (0, 2, 2),
                   (19, "Other"): (0, 1, 1), (19, "Battery"): (0, 2, 2),
                   (18, "Shipping"): (1, 1, 2), (18, "Other"): (0, 1, 1)}


def test_dashboard_without_email_dates_skips_daily_spam_only(spark):
    ratings = spark.createDataFrame([("p", "4.5", "u1"), ("q", "2.0", "u1"), ("q", "x", "u2")],
                                    "PRODUCT_ID string, Predicted_Rating string, user_id string")
    cube = spark.createDataFrame([("2024-01-01", "a", "5", "5", "10"), ("2024-01-02", "a", "1", "1", "2")],
                                 "date string, topic string, negative string, positive string, total_volume string")
    mails = spark.createDataFrame([("spam", "true"), ("ham", "0"), ("ham", "False")], "label string, is_spam string")
    d = K.dashboard(ratings, cube, mails)
    assert "spam_daily" not in d and "spam_spikes" not in d                    # Q17
    assert d["spam_rate"].first()["spam_count"] == 1
    assert {r["product_id"] for r in d["risky_products"].collect()} == {"q"}
    assert d["overall"].first()["total_volume"] == 12.0
    assert {r["rule"] for r in d["insights"].collect()} >= {"avg_rating", "neg_rate", "worst_topic", "spam_rate"}
    dated = K.email_kpis(mails.withColumn("sent_timestamp", F.lit("2024-01-01T10:00:00Z")))
    assert set(dated) >= {"spam_daily", "spam_spikes"}


def test_trend_report_api_shape(spark):
    raw = spark.createDataFrame([("2024-01-01T10:00:00Z", "pin yếu"), ("2024-01-01T11:00:00Z", "ship ok"),
                                 ("2024-01-01T12:00:00Z", "pin yếu"), ("junk", "pin")], "time string, content string")
    cube, summary = T.trend_report(raw)
    rows = {(r["date"], r["topic"]): r["negative_rate"] for r in cube.collect()}
    assert rows == {("2024-01-01", "Battery"): 1.0, ("2024-01-01", "Shipping"): 0.0}
    s = summary.first()
    assert (s["total_records"], s["total_days"]) == (3, 1)
