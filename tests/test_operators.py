"""Hand-computed fixture cases for the reference behaviours (Q1-Q19) and operator properties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from feedpulse.functions import schema as S
from feedpulse.functions import text as X
from feedpulse.operators import alerts as A
from feedpulse.operators import features as D
from feedpulse.operators import kpi as K
from feedpulse.operators import metrics as M
from feedpulse.operators import timeseries as J
from feedpulse.operators import trend as T
from feedpulse.operators.ordering import dense_index, running_count
from feedpulse.operators.split import split_random, split_stratified

d = dt.date


def cube_rows(spark, rows):
    return spark.createDataFrame(rows, "date date, topic string, negative long, positive long, neutral long, "
                                       "total_volume long")


# ------------------------------------------------------------------ trend (G, Q12, Q13)

def test_trend_demo_frame(spark):
    # the trend job's demo: three days of comments, keyword rules
    rows = [("2024-01-01T10:00:00Z", "pin yếu quá"), ("2024-01-01T11:00:00Z", "ship nhanh"),
            ("2024-01-01T12:00:00Z", "pin tốt"), ("2024-01-02T09:00:00Z", "ship chậm, pin yếu"),
            ("bad date", "pin yếu")]
    raw = spark.createDataFrame(rows, "date string, comment string")
    from feedpulse.operators.scoring import prepare_feed, score_feed
    cube = T.trend_daily(score_feed(prepare_feed(raw)))
    got = {(r["date"], r["topic"]): (r["Negative"], r["Positive"], r["total_volume"], r["negative_rate"])
           for r in cube.collect()}
    assert got == {(d(2024, 1, 1), "Battery"): (1, 1, 2, 0.5), (d(2024, 1, 1), "Shipping"): (0, 1, 1, 0.0),
                   (d(2024, 1, 2), "Battery"): (1, 0, 1, 1.0)}


def test_unknown_sentiment_excluded_from_total(spark):
    df = spark.createDataFrame([(d(2024, 1, 1), "a", "Negative"), (d(2024, 1, 1), "a", "Mixed")],
                               "date date, topic string, sentiment string")
    r = T.trend_daily(df).first()
    assert (r["Negative"], r["total_volume"], r["negative_rate"]) == (1, 1, 1.0)
    p = T.trend_rates(T.pivot_sentiment(T.volume_by_day(df)), round_to=2).first()
    assert "Mixed" not in p.asDict() and p["negative_rate"] == 1.0


# ------------------------------------------------------------------ KPIs (Q1, Q2, Q16, Q18)

def test_topic_growth_is_real_percent_and_missing_is_zero(spark):
    rows = [(d(2024, 1, 14), "a", 0, 0, 0, 30), (d(2024, 1, 5), "a", 0, 0, 0, 10),
            (d(2024, 1, 14), "b", 0, 0, 0, 5),            # only recent -> growth 0 (Q2)
            (d(2024, 1, 3), "c", 0, 0, 0, 7)]              # only previous -> growth 0
    g = {r["topic"]: (r["growth"], r["growth_pct"]) for r in K.topic_growth(cube_rows(spark, rows), k=None).collect()}
    assert g == {"a": (20.0, 200.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}


def test_spikes_use_sample_std_and_null_std(spark):
    daily = spark.createDataFrame([(d(2024, 1, i), v) for i, v in enumerate([10, 10, 10, 10, 50], 1)],
                                  "date date, total_volume long")
    assert [r["date"] for r in K.spikes(daily).collect()] == [d(2024, 1, 5)]
    one = spark.createDataFrame([(d(2024, 1, 1), 5)], "date date, total_volume long")
    assert K.spikes(one).count() == 0  # std null -> 0, 5 > 5 is false


def test_product_stats_pct_counts_null_as_not_high(spark):
    r = spark.createDataFrame([("p", 5.0), ("p", 3.0), ("p", None), ("q", 2.0)],
                              "product_id string, predicted_rating double")
    s = {x["product_id"]: x for x in K.product_stats(r).collect()}
    assert s["p"]["review_count"] == 2 and s["p"]["avg_rating"] == 4.0
    assert math.isclose(s["p"]["pct_ge_4"], 100 / 3)
    assert s["q"]["rating_std"] is None
    assert [x["product_id"] for x in K.risky_products(K.product_stats(r)).collect()] == ["q"]


def test_weekly_drift_last_two_weeks_present(spark):
    rows = [("p", 4.0, d(2024, 1, 1)), ("p", 2.0, d(2024, 1, 15)), ("q", 3.0, d(2024, 1, 15)),
            ("r", 5.0, d(2023, 12, 1))]
    r = spark.createDataFrame(rows, "product_id string, predicted_rating double, date date")
    got = {x["product_id"]: x["drift_pct"] for x in K.weekly_drift(r).collect()}
    assert got == {"p": -50.0, "q": 0.0, "r": 0.0}  # weeks present: 1 Jan and 15 Jan (Q18)


def test_spam_daily_truncates_to_day(spark):
    e = spark.createDataFrame([(True, dt.datetime(2024, 1, 1, 9)), (True, dt.datetime(2024, 1, 1, 18)),
                               (False, dt.datetime(2024, 1, 1, 19))], "is_spam boolean, date timestamp")
    assert [tuple(x) for x in K.spam_daily(e).collect()] == [(d(2024, 1, 1), 2)]


def test_label_share_and_others(spark):
    e = spark.createDataFrame([(x,) for x in "aaaabbbcdefg"], "label string")
    share = K.label_share(e)
    top = share.where("is_top").first()
    assert top["label"] == "a" and top["pct"] == 33.3
    rest = {r["label"]: r["pct"] for r in K.top_n_others(share, 5).collect()}
    assert set(rest) == {"a", "b", "c", "d", "e", "Others"} and math.isclose(rest["Others"], 16.6)


def test_insight_rules(spark):
    r = spark.createDataFrame([("p", 4.5), ("q", 4.4)], "product_id string, predicted_rating double")
    cube = cube_rows(spark, [(d(2024, 1, 1), "a", 5, 5, 0, 10)])
    rules = {x["rule"] for x in K.insights(r, cube).collect()}
    assert "polarisation" in rules and "crisis" not in rules
    st = {x["rule"] for x in K.insights(r, cube_rows(spark, [(d(2024, 1, 1), "a", 0, 5, 0, 5)]),
                                         with_stable=True).collect()}
    assert "stable" in st


def test_histogram_and_kde_shapes(spark):
    r = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 5]], "predicted_rating double")
    h = K.rating_hist(r).orderBy("bin").collect()
    assert len(h) == 20 and h[-1]["count"] == 2 and sum(x["count"] for x in h) == 6
    k = K.rating_kde(r).collect()
    assert len(k) == 200
    step = k[1]["x"] - k[0]["x"]
    assert math.isclose(sum(x["density"] for x in k) * step, 1.0, rel_tol=0.02)


# ------------------------------------------------------------------ text (Q6, Q9, Q10, Q11)

def test_text_functions(spark):
    df = spark.createDataFrame([("  Đà Nẵng 2024! Pin YẾU  ", "spam", "NEGATIVE")], "t string, l string, s string")
    r = df.select(X.clean_vi("t").alias("vi"), X.clean_vi("t", keep_d=True).alias("vi_d"),
                  X.clean_trend("t").alias("tr"), X.clean_basic("t").alias("b"),
                  X.spam_target("l", "strict").alias("st"), X.spam_target(F.lit("support"), "strict").alias("st2"),
                  X.spam_target(F.lit("support"), "one_vs_rest").alias("ovr"),
                  X.norm_sentiment("s").alias("ns"), X.translate_label(F.lower("s")).alias("tl")).first()
    assert r["vi"] == "  à nẵng  pin yếu  "          # no đ, no digits (Q11)
    assert r["vi_d"] == "  đà nẵng  pin yếu  "
    assert r["tr"] == "đà nẵng 2024 pin yếu"
    assert r["b"] == "đà nẵng 2024! pin yếu"
    assert (r["st"], r["st2"], r["ovr"]) == (1, None, 0)
    assert (r["ns"], r["tl"]) == ("Negative", "tiêu cực")


def test_codes_and_clip(spark):
    df = spark.createDataFrame([(0, 7.0), (2, float("nan")), (9, -1.0), (1, None)], "c int, x double")
    got = [(r["s"], r["x"]) for r in df.select(X.norm_sentiment("c", integral=True).alias("s"),
                                                X.clip_rating("x").alias("x")).collect()]
    assert got == [("Negative", 5.0), ("Neutral", 3.0), ("Neutral", 1.0), ("Positive", 3.0)]


def test_full_description_five_fields(spark):
    df = spark.createDataFrame([("T", None, "N", "M", "C")], "title string, text string, name string, "
                                                             "manufacturer string, categories string")
    assert df.select(X.full_description()).first()[0] == "t  n m c"


# ------------------------------------------------------------------ schema (Q3, Q4, Q17)

def test_resolve_accepts_product_id_and_defaults(spark):
    from feedpulse.plans.q_schema import RECSYS_ALIASES, RECSYS_TEXT_DEFAULTS
    raw = spark.createDataFrame([(1, 10, 5)], "user_id int, product_id int, rating int")
    r = S.resolve(raw, RECSYS_ALIASES, RECSYS_TEXT_DEFAULTS).first()
    assert (r["item_id"], r["text"], r["title"]) == (10, "", "")
    with pytest.raises(ValueError):
        S.resolve(raw, {"text": ["comment", "reviews.text"]})


def test_validate_lists_all_errors(spark):
    df = spark.createDataFrame([], "date string")
    errs = S.validate(df, ["date", "topic", "total_volume"], "trend")
    assert len(errs) == 3 and errs[-1] == "trend: no rows"


def test_lenient_casts(spark):
    df = spark.createDataFrame([("2016-03-08T20:21:53Z", "1.5", "TRUE"), ("junk", "x", "0")],
                               "ts string, n string, f string")
    r = df.select(S.to_ts("ts").alias("ts"), S.to_num("n", 0.0).alias("n"), S.to_flag("f").alias("f")).collect()
    assert r[0]["ts"] == dt.datetime(2016, 3, 8, 20, 21, 53) and r[1]["ts"] is None
    assert [x["n"] for x in r] == [1.5, 0.0] and [x["f"] for x in r] == [True, False]


def test_rename_aliases_coalesces(spark):
    df = spark.createDataFrame([(None, "i2", "t")], "asins string, item_id string, title string")
    r = S.rename_aliases(df, {"asins": "product_id", "item_id": "product_id"}).first()
    assert r["product_id"] == "i2"


# ------------------------------------------------------------------ ordering / encoders / splits

def test_dense_index_matches_dense_rank(spark):
    vals = [("k%03d" % (i % 50),) for i in range(1000)] + [("hot",)] * 2000
    df = spark.createDataFrame(vals, "v string")
    got = {r["v"]: r["idx"] for r in dense_index(df, "v", partitions=7).collect()}
    want = {v: i for i, v in enumerate(sorted({x[0] for x in vals}))}
    assert got == want


def test_running_count_equals_window(spark):
    rows = [(i, "a" if i % 3 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = running_count(df, ["k"], ["ts", "id"])
    from pyspark.sql import Window
    want = df.withColumn("value", F.count(F.lit(1)).over(Window.partitionBy("k").orderBy("ts", "id")
                                                          .rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.select("id", "value").collect())) == sorted(map(tuple, want.select("id", "value").collect()))


def test_apply_index_unseen_is_cold(spark):
    dic = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, idx int")
    df = spark.createDataFrame([("b",), ("z",)], "item_id string")
    got = {r["item_id"]: (r["idx"], r["is_cold_start"]) for r in D.apply_index(df, dic, "item_id").collect()}
    assert got == {"b": (1, False), "z": (0, True)}


def test_stratified_split_shares_and_disjoint(spark):
    rows = [(i, "spam" if i % 10 == 0 else "ham") for i in range(1, 1001)]
    s = split_stratified(spark.createDataFrame(rows, "id long, label string"), ["id"], "label", 0.2, 42)
    c = {(r["label"], r["is_test"]): r["count"] for r in s.groupBy("label", "is_test").count().collect()}
    assert c[("spam", True)] == 20 and c[("ham", True)] == 180
    assert s.count() == 1000 and s.select("id").distinct().count() == 1000


def test_random_split_is_reproducible(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = split_random(df, ["k"], 0.2, 1).where("is_test").select("k")
    b = split_random(df, ["k"], 0.2, 1).where("is_test").select("k")
    n = a.count()
    assert 850 < n < 1150 and a.subtract(b).count() == 0


def test_ngrams_and_stop_words(spark):
    df = spark.createDataFrame([(["free", "money", "now"],), (["one"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(D.ngrams("t", 2)).collect()]
    assert got == [["free", "money", "now", "free money", "money now"], ["one"], []]
    sw = D.remove_stop(spark.createDataFrame([(["the", "cat", "the"],)], "t array<string>"), "t").first()[0]
    assert sw == ["cat"]


def test_tfidf_smoothed_idf_and_l2(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "doc_id long, toks array<string>")
    voc = D.fit_vocab(docs, "doc_id", "toks")
    w = {(r["doc_id"], r["term"]): r["weight"] for r in D.tfidf(docs, voc, "doc_id", "toks").collect()}
    ia, ib = math.log(3 / 2) + 1, math.log(3 / 3) + 1
    na = math.sqrt((2 * ia) ** 2 + ib ** 2)
    assert math.isclose(w[(1, "a")], 2 * ia / na) and math.isclose(w[(2, "b")], 1.0)


# ------------------------------------------------------------------ metrics / time series / alerts

def test_clean_metric_events(spark):
    df = spark.createDataFrame([("pos", 1.5, 7.0, "", -1.0, 0), ("", 0.2, 2.0, "x", 1.0, 5)],
                               "sentiment string, confidence double, rating double, topic string, "
                               "processing_time double, batch_size int")
    r = M.clean_metric_events(df).collect()
    assert len(r) == 1 and (r[0]["confidence"], r[0]["rating"], r[0]["topic"], r[0]["processing_time"],
                            r[0]["batch_size"]) == (0.5, 5.0, "unknown", 0.0, 1)


def test_histogram_cumulative(spark):
    df = spark.createDataFrame([(0.3,), (0.55,), (0.97,)], "v double")
    h = {r["le"]: r["cum"] for r in M.histogram(df, "v", M.CONFIDENCE_BUCKETS).collect()}
    assert h[0.5] == 1 and h[0.6] == 2 and h[0.95] == 2 and h[1.0] == 3 and h[float("inf")] == 3


def _samples(spark, values, start=dt.datetime(2024, 1, 1), every=60):
    rows = [(start + dt.timedelta(seconds=every * i), "s", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp, k string, value double")


def test_increase_handles_reset(spark):
    s = _samples(spark, [1, 2, 5, 1, 3])  # reset after 5: deltas 1, 3, 1, 2
    inc = J.increase(s, ["k"], 600, 600).collect()
    assert sum(r["increase"] for r in inc) == 7.0


def test_histogram_quantile_linear(spark):
    b = spark.createDataFrame([("s", 0, 1.0, 10.0), ("s", 0, 2.0, 30.0), ("s", 0, float("inf"), 40.0)],
                              "k string, t long, le double, cum double")
    q = J.histogram_quantile(b, 0.5, ["k"]).first()["quantile"]
    assert math.isclose(q, 1.5)  # rank 20 in bucket (1, 2] holding 10..30
    q99 = J.histogram_quantile(b, 0.99, ["k"]).first()["quantile"]
    assert q99 == 2.0             # +Inf bucket -> highest finite edge


def test_alert_hold_gap_and_resolve(spark):
    step = 60
    vals = [(0, 5.0), (60, 5.0), (120, 5.0), (180, 1.0), (240, 5.0), (360, 5.0)]  # gap at 300
    e = spark.createDataFrame([("s", t, v) for t, v in vals], "k string, t long, v double")
    a = {(r["t"], r["state"]) for r in A.alerts(e, ["k"], "v", ">", 2.0, 120, step, "X").collect()}
    assert a == {(0, "pending"), (60, "pending"), (120, "firing"), (180, "resolved"),
                 (240, "pending"), (360, "pending")}


def test_route_group_inhibit(spark):
    rows = [("X", "critical", "c1", 0, "firing", None), ("X", "warning", "c1", 0, "firing", None),
            ("Y", "info", "c2", 0, "firing", "drift")]
    al = spark.createDataFrame(rows, "alertname string, severity string, component string, t long, "
                                     "state string, alert_type string")
    r = {(x["alertname"], x["severity"], x["receiver"]) for x in
         A.route(al, A.routes_frame(spark), ["severity", "alert_type"], ["alertname", "severity", "component", "t"]).collect()}
    assert r == {("X", "critical", "critical-alerts"), ("X", "warning", "warning-alerts"), ("Y", "info", "drift-alerts")}
    kept = {(x["alertname"], x["severity"]) for x in A.inhibit(al).collect()}
    assert kept == {("X", "critical"), ("Y", "info")}
    fires = spark.createDataFrame([("X", "critical", "c", t, "firing") for t in range(0, 30 * 3600, 3600)],
                                  "alertname string, severity string, component string, t long, state string")
    notes = [r["notify_at"] for r in A.group_alerts(fires, 3600).orderBy("notify_at").collect()]
    assert notes == [0, 12 * 3600, 24 * 3600]


def test_band(spark):
    df = spark.createDataFrame([(0.1,), (0.7,), (3.0,), (None,)], "v double")
    assert [r["status"] for r in J.band(df, "v").collect()] == ["green", "yellow", "red", None]


# ------------------------------------------------------------------ evaluation

def test_weighted_f1_zero_division(spark):
    from feedpulse.operators import evaluate as E
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "label string, prediction string")
    f1 = E.weighted_f1(df).first()[0]
    # class a: p = 2/3, r = 1, f1 = 0.8 (support 2); class b: f1 = 0 (support 1)
    assert math.isclose(f1, 0.8 * 2 / 3)
    assert math.isclose(E.accuracy(df).first()[0], 2 / 3)


# ------------------------------------------------------------------ files

def test_csv_folder_skips_unreadable_and_unions_by_name(spark, tmp_path):
    from feedpulse.sources import io as IO
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text('text,label\n"hello, ""world""\nline two",spam\n', encoding="utf-8")
    (folder / "b.csv").write_text("label,extra\nham,1\n", encoding="utf-8")
    (folder / "c.csv").write_bytes(b"")  # empty: skipped by the listing
    df = IO.read_csv_folder(spark, str(folder), skip_bad=True, multi_line=True)
    rows = {(r["text"], r["label"], r["extra"]) for r in df.collect()}
    assert rows == {('hello, "world"\nline two', "spam", None), (None, "ham", "1")}
    assert IO.rejected_files(spark, str(folder)).count() == 0
    only = IO.read_csv_folder(spark, str(folder), columns=["label"], multi_line=True)
    assert sorted(r[0] for r in only.collect()) == ["ham", "spam"]
    assert IO.read_any(spark, str(folder / "a.csv"), multiLine="true").count() == 1


def test_corrupt_rows_kept_and_map_matchers(spark, tmp_path):
    from pyspark.sql import types as T_
    from feedpulse.sources import io as IO
    folder = tmp_path / "raw2"
    folder.mkdir()
    (folder / "a.csv").write_text("n,label\n1,spam\nnot-a-number,ham\n", encoding="utf-8")
    sch = T_.StructType([T_.StructField("n", T_.IntegerType()), T_.StructField("label", T_.StringType())])
    rows = IO.read_csv_folder(spark, str(folder), sch, corrupt_col="_corrupt").orderBy("label").collect()
    assert rows[0]["n"] is None and rows[0]["_corrupt"] == "not-a-number,ham" and rows[1]["n"] == 1
    df = spark.createDataFrame([({"status": "503"}, 1.0), ({"status": "200"}, 2.0), ({}, 3.0)],
                               "labels map<string,string>, v double")
    got = [r["v"] for r in J.match(df, {"status": "=~5.."}, labels_map="labels").collect()]
    assert got == [1.0]
    assert sorted(r["v"] for r in J.match(df, {"status": "!=200"}, labels_map="labels").collect()) == [1.0, 3.0]


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    import numpy as np
    from feedpulse.operators.ordering import exact_quantiles
    rng = np.random.default_rng(3)
    vals = list(rng.normal(3.0, 1.0, 3000)) + [4.0] * 1500  # one value holds a third of the rows
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.9, 1.0), partitions=7).first()
    want = np.quantile(np.array(vals), [0.0, 0.25, 0.5, 0.9, 1.0])
    assert all(math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want))


def test_rule_table_and_rule_evaluation(spark):
    assert len(A.ALERT_RULES) == 20 and A.rules_frame(spark).count() == 20
    rule = next(r for r in A.ALERT_RULES if r[0] == "HighAPIErrorRate")
    expr = spark.createDataFrame([("api", t, 0.2) for t in range(0, 1200, 300)], "k string, t long, share double")
    live = {(0, "pending"), (300, "pending"), (600, "firing"), (900, "firing")}
    # a run that is live at the last evaluated instant is not resolved yet
    assert {(r["t"], r["state"]) for r in A.evaluate_rule(expr, ["k"], "share", rule, 300).collect()} == live
    more = expr.union(spark.createDataFrame([("other", 1200, 0.0)], expr.schema))
    got = {(r["t"], r["state"]) for r in A.evaluate_rule(more, ["k"], "share", rule, 300).collect()}
    assert got == live | {(1200, "resolved")}


def test_small_public_helpers(spark):
    from feedpulse.sources import io as IO
    df = spark.createDataFrame([(float("nan"), 1.0, bytearray("é".encode("utf-8"))),
                                (float("inf"), 2.0, bytearray("é".encode("latin-1")))], "a double, b double, raw binary")
    safe = IO.json_safe(df.drop("raw")).collect()
    assert [r["a"] for r in safe] == [None, None] and [r["b"] for r in safe] == [1.0, 2.0]
    assert [r[0] for r in df.select(IO.decode_text("raw")).collect()] == ["é", "é"]
    r = spark.createDataFrame([("pin yếu",), ("ship nhanh",)], "c string").select(X.rule_labels("c").alias("x")).collect()
    assert [(x["x"]["topic"], x["x"]["sentiment"]) for x in r] == [("Battery", "Negative"), ("Shipping", "Positive")]
    g = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10), "s", 2.0), (dt.datetime(2024, 1, 1, 0, 20), "s", 4.0)],
                              "ts timestamp, k string, value double")
    avg = {r["t"]: r["avg_over_time"] for r in J.avg_over_time(g, ["k"], 3600, 900).collect()}
    assert set(avg.values()) >= {3.0} and min(avg) % 900 == 0
    u = spark.createDataFrame([(3.0, 4.0, 1000, 400)], "used double, total double, t long, boot long") \
        .select(J.used_pct("used", "total").alias("p"), J.uptime("t", "boot").alias("up")).first()
    assert (u["p"], u["up"]) == (75.0, 600)
