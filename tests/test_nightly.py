"""The nightly chain: metrics are those of the written predictions; the alias moves only on promotion."""

import pytest

from feedpulse.operators import evaluate as E
from feedpulse.operators import nightly as N
from feedpulse.operators import train as TR


def rows(spark, mixed=False):
    words = {"positive": "great lovely fine", "negative": "awful broken late"}
    data = []
    for i in range(80):
        lab = "positive" if i % 2 else "negative"
        text = words["positive" if mixed and i % 4 < 2 else lab]
        data.append((i, lab, f"{text} item{i % 7}"))
    return spark.createDataFrame(data, "doc_id long, label string, text string")


def test_chain(spark, tmp_path):
    root, spec = str(tmp_path), TR.TextModelSpec(text_col="text", max_features=50)
    assert N.current_version(spark, root, "sentiment") is None
    with pytest.raises(LookupError):
        N.load_current(spark, root, "sentiment")
    first = {r["metric"]: r for r in N.nightly_text(rows(spark), "sentiment", spec, root).collect()}
    pred = N.predictions(spark, root, "sentiment", 1).collect()
    acc = sum(r["label"] == r["prediction"] for r in pred) / len(pred)
    assert len(pred) == 16 and first["accuracy"]["value"] == pytest.approx(acc) and acc == 1.0
    f1 = E.weighted_f1(N.predictions(spark, root, "sentiment", 1)).first()[0]
    assert first["weighted_f1"]["value"] == pytest.approx(f1)
    assert first["accuracy"]["promote"] and first["accuracy"]["is_current"]
    got = N.load_current(spark, root, "sentiment").transform(spark.createDataFrame([(1, "awful late", "negative")], "doc_id long, text string, label string"))
    assert got.first()["predicted_label"] == "negative"
    # a worse model is logged as version 2, and the alias stays
    bad = rows(spark).selectExpr("doc_id", "case when doc_id % 3 = 0 then 'negative' when doc_id % 3 = 1 then 'positive' else 'neutral' end as label", "text")
    second = {r["metric"]: r for r in N.nightly_text(bad, "sentiment", spec, root).collect()}
    assert second["accuracy"]["version"] == 2 and second["accuracy"]["value"] < 0.6
    assert not second["accuracy"]["promote"] and N.current_version(spark, root, "sentiment") == 1
    assert spark.read.parquet(f"{root}/run_metrics").count() == 4


def test_email_and_rating_chains(spark, tmp_path):
    root = str(tmp_path)
    mails = spark.createDataFrame([(i, ("win free money prize " if i % 3 == 0 else "meeting agenda notes ") + f"w{i % 5}", int(i % 3 == 0)) for i in range(90)],
                                  "doc_id long, text string, y int")
    spec = TR.TextModelSpec(text_col="text", label_col="y", max_features=50, grams=2)
    got = {r["metric"]: r for r in N.nightly_email(mails, spec, root, epochs=15).collect()}
    pred = N.predictions(spark, root, "email", 1).collect()
    assert len(pred) == 18 and got["accuracy"]["value"] == pytest.approx(sum(r["label"] == r["prediction"] for r in pred) / 18) == 1.0
    assert got["accuracy"]["promote"] and N.current_version(spark, root, "email") == 1
    rows = spark.createDataFrame([(i, f"u{i % 7}", f"p{i % 5}", 1 + i % 5, f"t{i % 5}", "", "", "") for i in range(300)],
                                 "k long, user_id string, item_id string, rating int, title string, name string, manufacturer string, categories string")
    got = {r["metric"]: r for r in N.nightly_rating(rows, ["k"], root, trees=5).collect()}
    pred = N.predictions(spark, root, "rating", 1).collect()
    assert got["rmse"]["value"] == pytest.approx((sum((r["label"] - r["prediction"]) ** 2 for r in pred) / len(pred)) ** 0.5) and got["rmse"]["value"] < 1
    assert got["rmse"]["promote"] and got["mae"]["is_current"]
    model = TR.RatingModel.load(spark, f"{root}/models/rating/v1")
    cold = model.score(rows.limit(1).selectExpr("'nobody' as user_id", "item_id", "title", "name", "manufacturer", "categories")).first()
    assert cold["is_cold_start"] and 1 <= cold["predicted_rating"] <= 5
