"""Registered metric (I1-I7) and time-series (J1-J12, J17, J18) queries.

Counters are the ``samples`` view (running event counts per event_type with a
reset after day 15); histograms and gauges use ``events.value``. Grid: 15 min
steps, 1 h ranges.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from feedpulse.operators import metrics as M
from feedpulse.operators import timeseries as J
from feedpulse.plans.q_kpi import round_doubles
from feedpulse.operators.ordering import running_count
from feedpulse.plans.registry import register
from feedpulse.plans.views import add_view_sql, feedback, samples, with_views
from feedpulse.session import scratch_path
from feedpulse.sources.tables import table

STEP, W = 900, 3600
K = W // STEP
S_US = STEP * 1_000_000
EDGES = M.EVENT_VALUE_BUCKETS
KEYS = ["event_type"]


def _bucket(ts: str = "ts") -> str:
    return f"(epoch_us({ts}) + {S_US - 1}) // {S_US} * {STEP}"


def _increase_sql(w: int, src: str = "samples") -> str:
    k = w // STEP
    return f"""select event_type, t, sum(d) as increase, cast(sum(n) as bigint) as samples from (
      select event_type, b + j * {STEP} as t, d, n from (
        select event_type, b, sum(d) as d, count(*) as n from (
          select event_type, {_bucket()} as b,
                 case when prev is null then 0.0 when value >= prev then value - prev else cast(value as double) end as d
          from (select *, lag(value) over (partition by event_type order by ts, value) as prev from {src}) l) x
        group by event_type, b) per, range(0, {k}) r(j)) e
    group by event_type, t"""


add_view_sql("inc1h", _increase_sql(W), ("samples",))
add_view_sql("rate1h", f"select event_type, t, increase / {float(W)} as rate, samples from inc1h", ("inc1h",))
add_view_sql("rate2h", f"select event_type, t, increase / {float(2 * W)} as rate, samples from ({_increase_sql(2 * W)}) i",
             ("samples",))

_le_cols = ", ".join(f"count(*) filter (where value <= {float(e)}) as le{i}" for i, e in enumerate(EDGES))
_le_sums = ", ".join(f"sum(le{i}) as le{i}" for i in range(len(EDGES)))
_le_list = "[" + ", ".join(f"{float(e)}::double" for e in EDGES) + ", 'inf'::double]"
_cum_list = "[" + ", ".join(f"le{i}" for i in range(len(EDGES))) + ", cnt]"
add_view_sql("hist1h", f"""select event_type, t, sm as sum, cnt as count,
      unnest({_le_list}) as le, cast(unnest({_cum_list}) as double) as cum from (
    select event_type, t, {_le_sums}, sum(cnt) as cnt, sum(sm) as sm from (
      select event_type, b + j * {STEP} as t, per.* exclude (event_type, b) from (
        select event_type, {_bucket()} as b, {_le_cols}, count(*) as cnt, sum(value) as sm
        from events group by 1, 2) per, range(0, {K}) r(j)) e
    group by event_type, t) g""")


def _quantile_sql(q: float) -> str:
    return f"""with w as (select *, lag(le) over (partition by event_type, t order by le) as pl,
                  lag(cum) over (partition by event_type, t order by le) as pc,
                  max(cum) over (partition by event_type, t) as tot,
                  max(case when le <> 'inf'::double then le end) over (partition by event_type, t) as mf from hist1h),
       hit as (select *, row_number() over (partition by event_type, t order by le) as rn
               from w where cum >= {q}::double * tot)
    select event_type, t, round(case when tot <= 0 then null when le = 'inf'::double then mf
        when pl is null and le <= 0 then le
        else coalesce(pl, 0.0) + (le - coalesce(pl, 0.0)) * (({q}::double * tot - coalesce(pc, 0.0)) / (cum - coalesce(pc, 0.0)))
        end, 6) as quantile from hit where rn = 1"""


def spark_samples(spark, sf):
    return samples(spark, sf)


def spark_events(spark, sf):
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
                                             "event_id", "user_id")


def hist_1h(spark, sf):
    return J.bucket_increase(spark_events(spark, sf), KEYS, "value", EDGES, W, STEP)


def _r(df, digits=9):
    return round_doubles(df, digits)


# ---------------------------------------------------------------- J operators

@register("increase_1h", with_views("select * from inc1h", "inc1h"))
def q_increase(spark, sf):
    return J.increase(spark_samples(spark, sf), KEYS, W, STEP)


add_view_sql("null_samples", """select ts, case when event_type <> 'signup' then event_type end as event_type,
    count(*) over (partition by case when event_type <> 'signup' then event_type end order by ts, event_id) as value from events""")


@register("increase_null_series", with_views(f"""with d as (select event_type, cast(ceil(epoch_us(ts) / 1000000.0 / {STEP}) as bigint) * {STEP} as b,
        coalesce(value - lag(value) over (partition by event_type order by ts, value), 0) as delta from null_samples)
    select event_type, b + j * {STEP} as t, cast(sum(delta) as double) as increase, count(*) as samples
    from d, range(0, {W // STEP}) r(j) group by 1, 2""", "null_samples"))
def q_increase_null_series(spark, sf):
    """J1 over samples of which one series has no label: it is a series like any other."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id",
                                          F.when(F.col("event_type") != "signup", F.col("event_type")).alias("event_type"))
    return J.increase(running_count(e, ["event_type"], ["ts", "event_id"]), ["event_type"], W, STEP)


@register("rate_1h", with_views("select event_type, t, round(rate, 9) as rate, samples from rate1h", "rate1h"))
def q_rate(spark, sf):
    return _r(J.rate(spark_samples(spark, sf), KEYS, W, STEP))


@register("sum_rate", with_views("select t, round(sum(rate), 9) as rate from rate1h group by t", "rate1h"))
def q_sum_rate(spark, sf):
    return _r(J.agg_by(J.rate(spark_samples(spark, sf), KEYS, W, STEP), [], "rate", "sum"))


@register("avg_rate_by_type", with_views(
    "select t, event_type, round(avg(rate), 9) as rate from rate1h group by t, event_type", "rate1h"))
def q_avg_rate(spark, sf):
    return _r(J.agg_by(J.rate(spark_samples(spark, sf), KEYS, W, STEP), KEYS, "rate", "avg"))


@register("match_labels", with_views(
    "select event_type, t, round(rate, 9) as rate, samples from rate1h "
    "where regexp_full_match(event_type, '(?:c.*|v.*|s.*)') and event_type <> 'view'", "rate1h"))
def q_match(spark, sf):
    r = J.rate(spark_samples(spark, sf), KEYS, W, STEP)
    return _r(J.match(r, {"event_type": "=~c.*|v.*|s.*"}).transform(lambda d: J.match(d, {"event_type": "!=view"})))


@register("histogram_quantile_p95", with_views(_quantile_sql(0.95), "hist1h"))
def q_hq95(spark, sf):
    return round_doubles(J.histogram_quantile(hist_1h(spark, sf), 0.95, KEYS))


@register("histogram_quantile_p50", with_views(_quantile_sql(0.5), "hist1h"))
def q_hq50(spark, sf):
    return round_doubles(J.histogram_quantile(hist_1h(spark, sf), 0.5, KEYS))


@register("hist_mean", with_views(
    "select event_type, t, round(case when count > 0 then sum / count end, 6) as mean from hist1h "
    "where le = 'inf'::double", "hist1h"))
def q_hist_mean(spark, sf):
    return round_doubles(J.hist_mean(hist_1h(spark, sf), KEYS))


@register("target_deviation", with_views(
    "select event_type, t, round(case when count > 0 then sum / count end, 6) as mean, "
    "round(abs(case when count > 0 then sum / count end / 50.0 - 3.0), 6) as deviation "
    "from hist1h where le = 'inf'::double", "hist1h"))
def q_target_deviation(spark, sf):
    m = J.hist_mean(hist_1h(spark, sf), KEYS)
    d = J.target_deviation(m.withColumn("__r", F.col("mean") / 50.0), "__r", 3.0).drop("__r")
    return round_doubles(d)


@register("error_share", with_views(
    """select e.t, round(case when a.rate <> 0 then e.rate / a.rate end, 9) as ratio
    from (select t, rate from rate1h where event_type = 'error') e
    join (select t, sum(rate) as rate from rate1h group by t) a on e.t = a.t""", "rate1h"))
def q_error_share(spark, sf):
    r = J.rate(spark_samples(spark, sf), KEYS, W, STEP)
    num = J.match(r, {"event_type": "error"}).select("t", "rate")
    den = J.agg_by(r, [], "rate", "sum")
    return _r(J.ratio(num, den, ["t"], "rate", "rate"))


@register("busy_pct", with_views(
    """select v.t, round(100.0 * (1.0 - case when a.rate <> 0 then v.rate / a.rate end), 9) as busy_pct
    from (select t, rate from rate1h where event_type = 'view') v
    join (select t, sum(rate) as rate from rate1h group by t) a on v.t = a.t""", "rate1h"))
def q_busy_pct(spark, sf):
    r = J.rate(spark_samples(spark, sf), KEYS, W, STEP)
    idle = J.match(r, {"event_type": "view"}).select("t", "rate")
    return _r(J.busy_pct(idle, J.agg_by(r, [], "rate", "sum"), ["t"], "rate", "rate"))


@register("avg_over_time", with_views(
    f"""select event_type, t, round(sum(s) / sum(c), 6) as avg_over_time from (
      select event_type, b + j * {STEP} as t, s, c from (
        select event_type, {_bucket()} as b, sum(value) as s, count(*) as c from events group by 1, 2) p,
      range(0, {K}) r(j)) e group by event_type, t""", "samples"))
def q_avg_over_time(spark, sf):
    return round_doubles(J.over_time(spark_events(spark, sf), KEYS, W, STEP, "avg"))


@register("offset_delta", with_views(
    """select a.event_type, a.t, round(abs(a.rate - b.rate), 9) as delta
    from rate1h a join (select event_type, t + 3600 as t, rate from rate2h) b
      on a.event_type = b.event_type and a.t = b.t""", "rate1h", "rate2h"))
def q_offset_delta(spark, sf):
    return _r(J.offset_delta(spark_samples(spark, sf), KEYS, W, 2 * W, 3600, STEP))


@register("imbalance", with_views(
    f"""with last as (
      select event_type, t, arg_max(v, lts) as v from (
        select event_type, b + j * {STEP} as t, v, lts from (
          select event_type, {_bucket()} as b, arg_max(value, ts) as v, max(ts) as lts from samples group by 1, 2) p,
        range(0, {K}) r(j)) e group by event_type, t)
    select event_type, t, round(case when avg(v) over (partition by t) <> 0
        then (v - avg(v) over (partition by t)) / avg(v) over (partition by t) end, 9) as imbalance from last""",
    "samples"))
def q_imbalance(spark, sf):
    last = J.over_time(spark_samples(spark, sf), KEYS, W, STEP, "last")
    return _r(J.imbalance(last, "event_type", "last_over_time"))


@register("band_p95", with_views(
    f"""select event_type, t, quantile, case when quantile is null then null
        when quantile / 100.0 >= 2.0 then 'red' when quantile / 100.0 >= 0.5 then 'yellow' else 'green' end as status
    from ({_quantile_sql(0.95)}) q""", "hist1h"))
def q_band(spark, sf):
    q = round_doubles(J.histogram_quantile(hist_1h(spark, sf), 0.95, KEYS))
    b = J.band(q.withColumn("__s", F.col("quantile") / 100.0), "__s")
    return b.drop("__s")


@register("record_rate", with_views("select event_type, t, round(rate, 9) as rate, samples from rate1h", "rate1h"))
def q_record(spark, sf):
    r = _r(J.rate(spark_samples(spark, sf), KEYS, W, STEP))
    return J.record(r, scratch_path(spark, f"recorded/{hashlib.md5(sf.encode()).hexdigest()[:8]}"), "rate_1h")


# ---------------------------------------------------------------- I operators

def metric_inputs(spark, sf):
    """Per-row metric inputs derived from events (one scored row per event)."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("sentiment"),
        (F.col("value") / 100.0).alias("confidence"),
        (F.col("value") / 50.0).alias("rating"),
        F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("event_type")).alias("topic"),
        (F.col("value") - 50.0).alias("processing_time"),
        (F.col("user_id") - 50).alias("batch_size"))


@register("clean_metric_events", """select event_id, event_type as sentiment,
    case when value / 100.0 >= 0 and value / 100.0 <= 1 then value / 100.0 else 0.5 end as confidence,
    least(greatest(value / 50.0, 1.0), 5.0) as rating,
    case when event_type = 'signup' then 'unknown' else event_type end as topic,
    greatest(value - 50.0, 0.0) as processing_time,
    case when user_id - 50 <= 0 then 1 else user_id - 50 end as batch_size, false as is_cold_start
    from events where event_type <> 'error'""")
def q_clean_metric_events(spark, sf):
    return M.clean_metric_events(metric_inputs(spark, sf))


@register("clean_metric_events_text", """select event_id, case when event_id % 7 = 1 then 0.5
      when value / 100.0 between 0 and 1 then value / 100.0 else 0.5 end as confidence,
    case when event_id % 5 = 2 then 3.0 else least(greatest(value / 50.0, 1.0), 5.0) end as rating,
    case when event_id % 3 = 0 then 0.0 else greatest(value - 50.0, 0.0) end as processing_time,
    case when event_id % 4 = 1 then cast(1 as bigint) else greatest(user_id, 1) end as batch_size,
    event_id % 2 = 0 as is_cold_start from events""")
def q_clean_metric_events_text(spark, sf):
    """I1 on text inputs with invalid rows: 'abc', 'NaN', '' and null fall back instead of failing."""
    e = table(spark, sf, "events")
    k = F.col("event_id")

    def text(bad, value):
        return F.when(bad, F.element_at(F.array(F.lit("abc"), F.lit("NaN"), F.lit("")), (k % 3 + 1).cast("int"))).otherwise(value.cast("string"))

    rows = e.select("event_id", text(k % 7 == 1, F.col("value") / 100.0).alias("confidence"),
                    text(k % 5 == 2, F.col("value") / 50.0).alias("rating"),
                    text(k % 3 == 0, F.col("value") - 50.0).alias("processing_time"),
                    F.when(k % 4 == 1, F.lit("none")).otherwise(F.col("user_id").cast("string")).alias("batch_size"),
                    F.when(k % 2 == 0, "TRUE").otherwise("no").alias("is_cold_start"))
    return M.clean_metric_events(rows)


@register("counter_sentiment", with_views(
    "select topic, sentiment, count(*) as value from feedback group by topic, sentiment", "feedback"))
def q_counter(spark, sf):
    return M.counter(feedback(spark, sf), ["topic", "sentiment"])


@register("histogram_value", f"""select event_type, round(sm, 6) as sum, cnt as count,
      unnest({_le_list}) as le, unnest({_cum_list}) as cum
    from (select event_type, {_le_cols}, count(*) as cnt, sum(value) as sm from events
          where value is not null group by event_type) g""")
def q_histogram(spark, sf):
    h = M.histogram(table(spark, sf, "events"), "value", EDGES, ["event_type"])
    return round_doubles(h)


@register("gauge_last", """select event_type, arg_max(value, (ts, event_id)) as value,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as at from events group by event_type""")
def q_gauge(spark, sf):
    g = M.gauge(table(spark, sf, "events"), ["event_type"], "value", "ts", tie="event_id")
    return g.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("throughput_daily", """select cast(ts as date) as day, event_type, count(*) as batch_size,
    round(sum(value) / 1000.0, 6) as seconds,
    round(case when sum(value) / 1000.0 > 0 then count(*) / (sum(value) / 1000.0) else 0.0 end, 6) as throughput
    from events group by 1, 2""")
def q_throughput(spark, sf):
    d = (table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type")
         .agg(F.count(F.lit(1)).alias("batch_size"), (F.sum("value") / 1000.0).alias("seconds")))
    return round_doubles(d.withColumn("throughput", M.throughput("batch_size", "seconds")))


def requests(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"),
        F.when(F.col("event_type") == "view", "/health").otherwise(F.concat(F.lit("/"), F.col("event_type"))).alias("endpoint"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status_code"),
        (F.col("value") / 100.0).alias("latency"))


add_view_sql("requests", """select case when event_type = 'purchase' then 'POST' else 'GET' end as method,
    case when event_type = 'view' then '/health' else '/' || event_type end as endpoint,
    case when event_type = 'error' then '500' else '200' end as status_code, value / 100.0 as latency from events""")


@register("request_counter", with_views(
    "select method, endpoint, status_code, count(*) as value from requests "
    "where endpoint not in ('/metrics', '/health') group by 1, 2, 3", "requests"))
def q_request_counter(spark, sf):
    return M.request_metrics(requests(spark, sf))[0]


_lat = M.DEFAULT_LATENCY_BUCKETS
_lat_cols = ", ".join(f"count(*) filter (where latency <= {float(e)}) as le{i}" for i, e in enumerate(_lat))
_lat_le = "[" + ", ".join(f"{float(e)}::double" for e in _lat) + ", 'inf'::double]"
_lat_cum = "[" + ", ".join(f"le{i}" for i in range(len(_lat))) + ", cnt]"


@register("request_latency_histogram", with_views(
    f"""select method, endpoint, round(sm, 6) as sum, cnt as count, unnest({_lat_le}) as le, unnest({_lat_cum}) as cum
    from (select method, endpoint, {_lat_cols}, count(*) as cnt, sum(latency) as sm from requests
          where endpoint not in ('/metrics', '/health') and latency is not null group by 1, 2) g""", "requests"))
def q_request_hist(spark, sf):
    return round_doubles(M.request_metrics(requests(spark, sf))[1])


@register("filter_metrics", """select metric, count(*) as value, 'production' as environment, 'backend-1' as instance
    from (select case event_type when 'click' then 'api_click_total' when 'view' then 'debug_view_total'
                 when 'error' then 'internal_errors_total' when 'signup' then 'model_signup_total'
                 else 'batch_purchase_total' end as metric from events) m
    where regexp_full_match(metric, '(?:model_.*|api_.*|infra_.*|system_.*|batch_.*)')
      and not regexp_full_match(metric, '(?:debug_.*|internal_.*|_internal_.*)')
    group by metric""")
def q_filter_metrics(spark, sf):
    name = (F.when(F.col("event_type") == "click", "api_click_total")
             .when(F.col("event_type") == "view", "debug_view_total")
             .when(F.col("event_type") == "error", "internal_errors_total")
             .when(F.col("event_type") == "signup", "model_signup_total")
             .otherwise("batch_purchase_total"))
    m = table(spark, sf, "events").select(name.alias("metric"))
    return M.filter_metrics(M.counter(M.filter_metrics(m, static={}), ["metric"]))


@register("match_map_labels", """select endpoint, count(*) as value from (
    select '/' || event_type as endpoint, case when event_type = 'error' then '500' else '200' end as status
    from events) r where regexp_full_match(status, '(?:5..)') group by endpoint""")
def q_match_map(spark, sf):
    """J4 on a label map: request samples carrying {endpoint, status} labels, 5xx only."""
    e = table(spark, sf, "events")
    labels = F.create_map(F.lit("endpoint"), F.concat(F.lit("/"), F.col("event_type")),
                          F.lit("status"), F.when(F.col("event_type") == "error", "500").otherwise("200"))
    s = e.select(labels.alias("labels"))
    m = J.match(s, {"status": "=~5.."}, labels_map="labels")
    return M.counter(m.select(F.element_at("labels", "endpoint").alias("endpoint")), ["endpoint"])
