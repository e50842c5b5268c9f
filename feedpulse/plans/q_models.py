"""Registered evaluation queries (E8-E12, oracle-checked) and model queries."""

from __future__ import annotations

import uuid


from pyspark.sql import Window
from pyspark.sql import functions as F

from feedpulse.functions import text as X
from feedpulse.operators import evaluate as E
from feedpulse.operators import features as D
from feedpulse.operators import train as TR
from feedpulse.operators import scoring as SC
from feedpulse.operators.kpi import scalar_join
from feedpulse.operators.split import split_random, split_stratified
from feedpulse.operators.trend import trend_daily
from feedpulse.plans.q_features import _KEYS
from feedpulse.plans.q_text import sql_clean_trend
from feedpulse.plans.registry import register
from feedpulse.plans.views import add_view_sql, day_from_no, emails, interactions, reviews, texts, with_views
from feedpulse.session import scratch_path, written
from feedpulse.sources.tables import table


def rule_eval(spark, sf):
    r = reviews(spark, sf)
    return r.select("doc_id", "label", F.lower(X.rule_sentiment(X.clean_trend("text"))).alias("prediction"))


add_view_sql("rule_eval", f"""select doc_id, label,
    case when contains({sql_clean_trend('text')}, 'yếu') then 'negative' else 'positive' end as prediction
    from reviews""", ("reviews",))
add_view_sql("pclass", """with conf as (select label as l, prediction as p, count(*) as n from rule_eval group by 1, 2),
    t as (select l as cls, cast(sum(n) as bigint) as support, cast(sum(case when l = p then n end) as bigint) as tp
           from conf group by l),
    pr as (select p as cls, cast(sum(n) as bigint) as predicted from conf group by p),
    j as (select coalesce(t.cls, pr.cls) as cls, coalesce(support, 0) as support, coalesce(tp, 0) as tp,
                 coalesce(predicted, 0) as predicted from t full outer join pr on t.cls = pr.cls),
    k as (select *, case when predicted > 0 then tp / predicted else 0.0 end as precision,
                    case when support > 0 then tp / support else 0.0 end as recall from j)
    select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1
    from k""", ("rule_eval",))


@register("per_class_rule", with_views(
    "select cls, support, tp, predicted, round(precision, 6) as precision, round(recall, 6) as recall, "
    "round(f1, 6) as f1 from pclass", "pclass"))
def q_per_class(spark, sf):
    from feedpulse.plans.q_kpi import round_doubles
    return round_doubles(E.per_class(rule_eval(spark, sf)))


@register("eval_rule_sentiment", with_views(
    """select round((select avg(case when prediction = label then 1.0 else 0.0 end) from rule_eval), 6) as accuracy,
       round(sum(f1 * support) / sum(support), 6) as weighted_f1 from pclass""", "pclass", "rule_eval"))
def q_eval_rule(spark, sf):
    ev = rule_eval(spark, sf)
    out = scalar_join(E.accuracy(ev), E.weighted_f1(ev))
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("weighted_f1", 6).alias("weighted_f1"))


add_view_sql("isplit2", f"""select *, cast(('0x' || substr(md5(concat_ws('|', '42', l_orderkey, l_linenumber,
    l_partkey, l_suppkey, l_extendedprice)), 1, 8)) as bigint) < {int(0.2 * (1 << 32))} as is_test
    from interactions""", ("interactions",))
add_view_sql("baseline", """with tr as (select * from isplit2 where not is_test),
    im as (select item_id, avg(rating) as m from tr group by item_id),
    g as (select avg(rating) as gm from tr)
    select t.rating as label, coalesce(im.m, g.gm) as prediction
    from isplit2 t left join im on t.item_id = im.item_id, g where t.is_test""", ("isplit2",))


def baseline_eval(spark, sf):
    s = split_random(interactions(spark, sf), _KEYS, 0.2, 42)
    tr = s.where(~F.col("is_test"))
    item_mean = tr.groupBy("item_id").agg(F.avg("rating").alias("__m"))
    gm = tr.agg(F.avg("rating").alias("__gm"))
    te = scalar_join(s.where("is_test").join(item_mean, "item_id", "left"), gm)
    return te.select(F.col("rating").alias("label"), F.coalesce("__m", "__gm").alias("prediction"))


@register("regression_baseline", with_views(
    "select round(sqrt(avg((prediction - label) * (prediction - label))), 6) as rmse, "
    "round(avg(abs(prediction - label)), 6) as mae from baseline", "baseline"))
def q_regression(spark, sf):
    m = E.regression_metrics(baseline_eval(spark, sf))
    return m.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


def _metric_rows(spark, sf):
    ev = rule_eval(spark, sf)
    acc = E.accuracy(ev).select(F.lit("sentiment").alias("model"), F.lit("accuracy").alias("metric"),
                                F.col("accuracy").alias("value"))
    rm = E.regression_metrics(baseline_eval(spark, sf)).select(
        F.lit("rating").alias("model"), F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))
    return acc.unionByName(rm)


@register("promote", with_views(
    """select model, metric, round(value, 6) as value, op, threshold,
       case when op = '>=' then value >= threshold when op = '<' then value < threshold end as promote from (
      select 'sentiment' as model, 'accuracy' as metric,
             (select avg(case when prediction = label then 1.0 else 0.0 end) from rule_eval) as value, '>=' as op,
             0.6::double as threshold
      union all select 'rating', 'rmse', (select sqrt(avg((prediction - label) * (prediction - label))) from baseline),
             '<', 2.0::double) m""", "rule_eval", "baseline"))
def q_promote(spark, sf):
    p = E.promote(_metric_rows(spark, sf), E.rules_frame(spark))
    return p.select("model", "metric", F.round("value", 6).alias("value"), "op", "threshold", "promote")


@register("run_log_roundtrip", with_views(
    """select 'accuracy' as key, round(avg(case when prediction = label then 1.0 else 0.0 end), 6) as value,
       cast(0 as bigint) as step from rule_eval""", "rule_eval"))
def q_run_log(spark, sf):
    root = scratch_path(spark, "runs")
    ev = rule_eval(spark, sf)
    run_id = E.log_run(spark, root, "sentiment_rules", {"source": "reviews", "sf": sf},
                       E.metrics_long(E.accuracy(ev).select(F.round("accuracy", 6).alias("accuracy"))))
    return spark.read.parquet(f"{root}/run_metrics").where(F.col("run_id") == run_id).select("key", "value", "step")


add_view_sql("rule_feed", f"""select date '2024-01-01' + day_no as date,
    case when contains(c, 'pin') then 'Battery' when contains(c, 'ship') then 'Shipping' else 'Other' end as topic,
    case when contains(c, 'yếu') then 'Negative' else 'Positive' end as sentiment
    from (select day_no, {sql_clean_trend('text')} as c from texts) t""", ("texts",))


@register("scored_feed_trend", with_views(
    """select date, topic, count(*) filter (where sentiment = 'Negative') as Negative,
       count(*) filter (where sentiment = 'Positive') as Positive,
       count(*) filter (where sentiment = 'Neutral') as Neutral, count(*) as total_volume,
       count(*) filter (where sentiment = 'Negative') / count(*) as negative_rate
    from rule_feed group by date, topic""", "rule_feed"))
def q_scored_feed_trend(spark, sf):
    feed = texts(spark, sf).select(day_from_no(F.col("day_no")).alias("date"),
                                     X.clean_trend("text").alias("clean_text"))
    return trend_daily(SC.score_feed(feed))


# ---------------------------------------------------------------- fitted models (rows-only checks)

def _review_split(spark, sf):
    return split_stratified(reviews(spark, sf), ["doc_id"], "label", 0.2, 42)


def _split_sql(name: str, src: str, label: str, key: str = "doc_id") -> None:
    """The rows that ``split_stratified`` (seed 42, a fifth) holds out, as a view."""
    add_view_sql(name, f"""select * from (select *, row_number() over (partition by {label} order by
         cast(('0x' || substr(md5(concat_ws('|', '42', {key})), 1, 8)) as bigint), {key})
         <= ceil(0.2 * count(*) over (partition by {label})) as is_test from {src}) s where is_test""", (src,))


_split_sql("review_test", "reviews", "label")
_split_sql("topic_test", "texts", "topic")


def _in_range(c, low: float = 0.0):
    return F.col(c).between(low, 1.0)


def _same_rows(a, b, key: str):
    """``a`` with ``same``: whether ``b`` (its columns from a reloaded model) has the same row for the key."""
    cols = [c for c in a.columns if c != key]
    j = a.join(b.select(key, F.struct(*cols).alias("__b")), key, "left")
    same = F.col("__b").isNotNull()
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col("__b")[c])
    return j.withColumn("same", same).drop("__b")


def _reloaded(spark, model):
    path = scratch_path(spark, f"models/{uuid.uuid4().hex[:12]}")
    TR.save_model(model, path)
    return TR.load_model(path)


def _sentiment_model(spark, sf):
    s = _review_split(spark, sf).withColumn("clean", X.clean_vi(X.null_text("text", "nan")))
    spec = TR.TextModelSpec(text_col="clean", max_features=TR.SENTIMENT_TERMS)
    test = s.where("is_test").select("doc_id", F.col("clean").alias("text"), "label").withColumn("clean", F.col("text"))
    return TR.train_logistic(s.where(~F.col("is_test")), spec), test


@register("sentiment_model_scores")
def q_sentiment_model(spark, sf):
    """E3 + F3: the sentiment job cleans with the Vietnamese letter class (C1) before tf-idf."""
    model, test = _sentiment_model(spark, sf)
    return SC.score_sentiment(test, model).select("doc_id", "label", "sentiment", "confidence")


@register("sentiment_model_exact", with_views(
    "select doc_id, label, true as known, true as in_range, true as same from review_test", "review_test"))
def q_sentiment_model_exact(spark, sf):
    """E3, E14, F3, what is exact of them: the held-out rows, known labels, confidences in range, reload = original."""
    model, test = _sentiment_model(spark, sf)
    a, b = (SC.score_sentiment(test, m).select("doc_id", "label", "sentiment", "confidence") for m in (model, _reloaded(spark, model)))
    known = F.col("sentiment").isin([r[0] for r in test.select(X.translate_label("label")).distinct().collect()])  # two labels
    return _same_rows(a, b, "doc_id").select("doc_id", "label", known.alias("known"),
                                             _in_range("confidence", 0.5).alias("in_range"), "same")


def _topic_model(spark, sf):
    """E4 over every document: the topic is its source and needs no label."""
    s = split_stratified(texts(spark, sf), ["doc_id"], "topic", 0.2, 42)
    spec = TR.TextModelSpec(label_col="topic", max_features=TR.TOPIC_TERMS)
    model = TR.train_linear_log(s.where(~F.col("is_test")), spec, max_iter=50)
    return model, s.where("is_test").select("doc_id", "text", F.col("topic").alias("true_topic"))


@register("topic_model_scores")
def q_topic_model(spark, sf):
    model, test = _topic_model(spark, sf)
    return SC.score_topic(test, model).select("doc_id", "true_topic", "topic", "confidence")


@register("topic_model_exact", with_views(
    "select doc_id, topic as true_topic, true as known, true as in_range, true as same from topic_test", "topic_test"))
def q_topic_model_exact(spark, sf):
    """E4, E14, F2, what is exact of them."""
    model, test = _topic_model(spark, sf)
    a, b = (SC.score_topic(test, m).select("doc_id", "true_topic", "topic", "confidence") for m in (model, _reloaded(spark, model)))
    topics = texts(spark, sf).select(F.col("topic"), F.lit(True).alias("known")).where("topic is not null").distinct()
    out = _same_rows(a, b, "doc_id").join(topics, "topic", "left")
    return out.select("doc_id", "true_topic", F.coalesce("known", F.lit(False)).alias("known"), _in_range("confidence").alias("in_range"), "same")


def _email_frame(spark, sf):
    e = (emails(spark, sf).withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
                          .withColumn("y", X.spam_target("label", "one_vs_rest"))
                          .withColumn("clean", X.clean_words(X.null_text("text"))))
    return split_stratified(e, ["doc_id"], "y", 0.2, 42)


EMAIL_SPEC = TR.TextModelSpec(text_col="clean", label_col="y", doc_col="doc_id", max_features=TR.EMAIL_TERMS,
                              min_df=TR.EMAIL_MIN_DF, stop=True, grams=2)


@register("email_model_scores")
def q_email_model(spark, sf):
    e = _email_frame(spark, sf)
    # early stopping as in the reference: a tenth of the training rows is held out
    model = TR.train_linear(e.where(~F.col("is_test")), EMAIL_SPEC, loss="modified_huber", max_iter=30)
    test = e.where("is_test").select("doc_id", "conv_id", "turn", "label", "clean")
    return SC.score_email(test, model).drop("clean")


add_view_sql("email_rows", "select *, conv_id * 1000 + turn as doc_id, case when label = 'spam' then 1 else 0 end as y from emails", ("emails",))
_split_sql("email_test", "email_rows", "y")


@register("email_model_exact", with_views(
    "select conv_id, turn, label, true as known, true as in_range, true as same from email_test", "email_test"))
def q_email_model_exact(spark, sf):
    """E5, E14, F4, what is exact of them."""
    e = _email_frame(spark, sf)
    model = TR.train_linear(e.where(~F.col("is_test")), EMAIL_SPEC, loss="modified_huber", max_iter=30)
    path = scratch_path(spark, f"models/{uuid.uuid4().hex[:12]}")
    model.save(path)
    test = e.where("is_test").select("doc_id", "conv_id", "turn", "label", "clean")
    a, b = (SC.score_email(test, m).drop("clean") for m in (model, TR.LinearTextModel.load(spark, path)))
    known = F.col("label_pred").isin("spam", "ham") & (F.col("is_spam_pred") == (F.col("label_pred") == "spam"))
    return _same_rows(a, b, "doc_id").select("conv_id", "turn", "label", known.alias("known"), _in_range("confidence", 0.5).alias("in_range"), "same")


@register("email_epoch_steps", """select key, cast(step as bigint) as step, true as in_range, true as falls
    from (values ('weighted_f1'), ('train_loss')) k(key), range(1, 11) r(step) where (select count(*) from conversations) > 0""")
def q_email_epoch_steps(spark, sf):
    """E6, what is exact of it: one row per epoch and metric, in range, and the loss never rises."""
    log = written(q_email_epochs(spark, sf), "epoch-log")
    before = F.lag("value").over(Window.partitionBy("key").orderBy("step"))  # ten rows a key
    falls = (F.col("key") != "train_loss") | before.isNull() | (F.col("value") <= before)
    return log.select("key", "step", (F.col("value") >= 0).alias("in_range"), falls.alias("falls"))


@register("email_epoch_log")
def q_email_epochs(spark, sf):
    """Ten epochs, weighted F1 on the test rows and the training loss logged per epoch."""
    e = _email_frame(spark, sf)
    _, metrics = TR.train_epochs(e.where(~F.col("is_test")), e.where("is_test"), EMAIL_SPEC, epochs=10)
    root = scratch_path(spark, "runs")
    run_id = E.log_run(spark, root, "email_tracking", {"epochs": 10, "alpha": TR.LINEAR_ALPHA}, metrics)
    return spark.read.parquet(f"{root}/run_metrics").where(F.col("run_id") == run_id)


add_view_sql("rating_cold", """with tr as (select * from isplit2 where not is_test),
       u as (select user_id, dense_rank() over (order by user_id) - 1 as user_idx
             from (select distinct user_id from tr) x),
       i as (select item_id, dense_rank() over (order by item_id) - 1 as item_idx
             from (select distinct item_id from tr) y)
    select t.l_orderkey, t.l_linenumber, t.l_partkey, coalesce(u.user_idx, 0) as user_idx,
           coalesce(i.item_idx, 0) as item_idx, (u.user_id is null) or (i.item_id is null) as is_cold_start
    from isplit2 t left join u on t.user_id = u.user_id left join i on t.item_id = i.item_id
    where t.is_test""", ("isplit2",))


def _rating_model(spark, sf, trees: int = TR.GBT_TREES):
    s = split_random(interactions(spark, sf), _KEYS, 0.2, 42)
    test = s.where("is_test").select("user_id", F.col("item_id").alias("product_id"), "title", "name",
                                     "manufacturer", "categories", "rating", "l_orderkey", "l_linenumber")
    return TR.RatingModel.fit(s.where(~F.col("is_test")), _KEYS, trees), test


@register("rating_model_scores")
def q_rating_model(spark, sf):
    model, test = _rating_model(spark, sf)
    return model.score(test)


@register("rating_model_exact", with_views(
    "select l_orderkey, l_linenumber, l_partkey, is_cold_start, true as in_range, true as same from rating_cold", "rating_cold"))
def q_rating_model_exact(spark, sf):
    """D9, E7, E14, F5, what is exact of them: the held-out rows, cold starts, ratings from 1 to 5, reload = original."""
    model, test = _rating_model(spark, sf, trees=20)
    test = written(test, "rating-test")  # scored by two models
    path = scratch_path(spark, f"models/{uuid.uuid4().hex[:12]}")
    model.save(path)
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "product_id")
    a, b = (m.score(test).withColumn("k", key) for m in (model, TR.RatingModel.load(spark, path)))
    a, b = (d.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("predicted_rating", "is_cold_start"))).alias("r")) for d in (a, b))
    out = _same_rows(a, b, "k").select("k", "same", F.explode("r").alias("r"))
    part = F.split("k", "[|]")
    return out.select(F.get(part, F.lit(0)).cast("bigint").alias("l_orderkey"), F.get(part, F.lit(1)).cast("int").alias("l_linenumber"),
                      F.get(part, F.lit(2)).cast("bigint").alias("l_partkey"), "r.is_cold_start",
                      F.col("r.predicted_rating").between(1, 5).alias("in_range"), "same")




add_view_sql("upload", """select strftime(date '2024-01-01' + cast(d.doc_id % 30 as int), '%Y-%m-%d') || 'T10:00:00Z' as created_at,
    d.text as comment from documents d""")


@register("trend_report_upload", with_views(
    f"""with s as (select cast(created_at[1:10] as date) as date,
          case when contains(c, 'pin') then 'Battery' when contains(c, 'ship') then 'Shipping' else 'Other' end as topic,
          case when contains(c, 'yếu') then 'Negative' else 'Positive' end as sentiment
        from (select created_at, {sql_clean_trend("coalesce(comment, 'nan')")} as c from upload) u)
    select strftime(date, '%Y-%m-%d') as date, topic,
       count(*) filter (where sentiment = 'Negative') as Negative,
       count(*) filter (where sentiment = 'Positive') as Positive,
       count(*) filter (where sentiment = 'Neutral') as Neutral, count(*) as total_volume,
       round(count(*) filter (where sentiment = 'Negative') / count(*), 2) as negative_rate
    from s group by date, topic""", "upload"))
def q_trend_report_upload(spark, sf):
    """G + F7 end to end: an upload-shaped frame (created_at text, comment) through ``trend_report``."""
    from feedpulse.operators.trend import trend_report
    d = table(spark, sf, "documents")
    raw = d.select(F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")),
                                          "yyyy-MM-dd"), F.lit("T10:00:00Z")).alias("created_at"),
                   F.col("text").alias("comment"))
    cube, _ = trend_report(raw)
    return cube


@register("rating_cold_start", with_views("select * from rating_cold", "rating_cold"))
def q_rating_cold_start(spark, sf):
    """Id features of the scoring path; unseen user or item -> index 0 and cold start."""
    s = split_random(interactions(spark, sf), _KEYS, 0.2, 42)
    tr = s.where(~F.col("is_test"))
    users = D.fit_index(tr, "user_id", "user_idx")
    items = D.fit_index(tr, "item_id", "item_idx")
    test = s.where("is_test").select("l_orderkey", "l_linenumber", "l_partkey", "user_id", "item_id")
    d = D.apply_index(test, users, "user_id", "user_idx", "__cu", value_col="user_idx")
    d = D.apply_index(d, items, "item_id", "item_idx", "__ci", value_col="item_idx")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "user_idx", "item_idx",
                    (F.col("__cu") | F.col("__ci")).alias("is_cold_start"))


# ---------------------------------------------------------------- given scores, aliases

@register("confidence_scores", """select event_id,
    round(greatest(value / (value + 40), 1 - value / (value + 40)), 4) as confidence_1d,
    round(greatest(value, 40, 25) / (value + 65), 4) as confidence_3d from events""")
def q_confidence(spark, sf):
    """F1 on given scores: the largest class probability, and max(p, 1 - p) of a single one."""
    from pyspark.ml.functions import array_to_vector
    v = F.col("value")
    three = array_to_vector(F.array(*[x / (v + 65) for x in (v, F.lit(40.0), F.lit(25.0))]))
    return table(spark, sf, "events").select("event_id", SC.binary_confidence(v / (v + 40)).alias("confidence_1d"),
                                             SC.confidence(three).alias("confidence_3d"))


@register("current_models", """select o_orderpriority as model,
    arg_max(o_orderkey, (o_orderdate, o_orderkey)) as version from orders where o_orderstatus = 'F' group by 1""")
def q_current_models(spark, sf):
    """E13 over a history of assignments (orders): per model the version that was set last."""
    h = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "production").otherwise("staging").alias("alias"), F.col("o_orderdate").alias("set_at"))
    return E.current_model(h)


# ---------------------------------------------------------------- nightly chain

@register("nightly_sentiment")
def q_nightly_sentiment(spark, sf):
    return _nightly(spark, sf, "sentiment", reviews(spark, sf).select("doc_id", "label", X.clean_vi(X.null_text("text", "nan")).alias("clean")),
                    TR.TextModelSpec(text_col="clean", max_features=TR.SENTIMENT_TERMS))


@register("nightly_topic")
def q_nightly_topic(spark, sf):
    return _nightly(spark, sf, "topic", texts(spark, sf).select("doc_id", F.col("topic").alias("label"), "text"),
                    TR.TextModelSpec(text_col="text", max_features=TR.TOPIC_TERMS))


def _nightly(spark, sf, name, rows, spec):
    from feedpulse.operators.nightly import nightly_text
    root = scratch_path(spark, f"nightly/{uuid.uuid4().hex[:12]}")
    return nightly_text(rows, name, spec, root, params={"sf": sf})


@register("nightly_email")
def q_nightly_email(spark, sf):
    from feedpulse.operators.nightly import nightly_email
    root = scratch_path(spark, f"nightly/{uuid.uuid4().hex[:12]}")
    return nightly_email(_email_frame(spark, sf).drop("is_test"), EMAIL_SPEC, root, params={"sf": sf})


@register("nightly_rating")
def q_nightly_rating(spark, sf):
    from feedpulse.operators.nightly import nightly_rating
    root = scratch_path(spark, f"nightly/{uuid.uuid4().hex[:12]}")
    return nightly_rating(interactions(spark, sf), _KEYS, root, trees=20, params={"sf": sf})


@register("nightly_exact", """select model, metric, cast(1 as int) as version, true as agrees, true as alias_follows
    from (values ('email', 'accuracy'), ('email', 'weighted_f1'), ('rating', 'rmse'), ('rating', 'mae')) m(model, metric)""")
def q_nightly_exact(spark, sf):
    """The chains of the e-mail and the rating model, what is exact of them: every metric can be computed again from the
    written predictions, and the alias follows the promotion."""
    from feedpulse.operators import nightly as N
    parts = []
    for name in ("email", "rating"):
        root = scratch_path(spark, f"nightly/{uuid.uuid4().hex[:12]}")
        if name == "email":
            out = N.nightly_email(_email_frame(spark, sf).drop("is_test"), EMAIL_SPEC, root, epochs=10)
        else:
            out = N.nightly_rating(interactions(spark, sf), _KEYS, root, trees=5)
        pred = N.predictions(spark, root, name, 1)
        again = E.metrics_long(N.classes_metrics(pred) if name == "email" else E.regression_metrics(pred))
        parts.append(out.join(again.select(F.col("key").alias("metric"), F.col("value").alias("again")), "metric").select(
            "model", "metric", "version", (F.abs(F.col("value") - F.col("again")) < 1e-9).alias("agrees"),
            (F.col("promote") == F.col("is_current")).alias("alias_follows")))
    return parts[0].unionByName(parts[1])
