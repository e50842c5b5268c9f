"""All alert rules over a metric table derived from the events: expressions (J1-J11) and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedpulse.operators import alerts as A
from feedpulse.operators.ordering import running_count
from feedpulse.plans.registry import register
from feedpulse.plans.views import add_view_sql, with_views
from feedpulse.sources.tables import table

STEP = 300
LATENCY_EDGES = ("0.5", "1.0", "2.0", "4.0")
MEAN_LOAD = 31.5  # seconds that each load adds to the duration counter

# Counters: (metric, labels as JSON, condition on events); each counts its events.
_COUNTERS = [
    ("model_prediction_errors_total", "{}", "event_type = 'error'"),
    ("model_load_failure_total", "{}", "event_type = 'signup' and value > 150"),
    ("batch_processing_count_total", '{"status":"failed"}', "event_type = 'purchase' and value > 60"),
    ("batch_processing_count_total", '{"status":"success"}', "event_type = 'purchase' and value <= 60"),
    ("model_sentiment_prediction_count", '{"sentiment":"negative"}', "event_type = 'view' and value < 30"),
    ("model_sentiment_prediction_count", '{"sentiment":"positive"}', "event_type = 'view' and value >= 30"),
    ("model_email_prediction_count", '{"label":"spam"}', "event_type = 'click' and event_id % 4 = 0"),
    ("model_email_prediction_count", '{"label":"ham"}', "event_type = 'click' and event_id % 4 in (1, 2)"),
    ("model_email_prediction_count", '{"label":"support"}', "event_type = 'click' and event_id % 4 = 3"),
    ("model_recsys_cold_start_total", "{}", "event_type = 'signup' and event_id % 2 = 0"),
    ("model_recsys_prediction_count", "{}", "event_type = 'signup'"),
    ("api_request_count_total", '{"status":"500"}', "event_type = 'error'"),
    ("api_request_count_total", '{"status":"200"}', "event_type <> 'error'"),
    ("model_load_duration_seconds_sum", "{}", "event_type = 'purchase'"),
    ("model_load_duration_seconds_count", "{}", "event_type = 'purchase'"),
    *[("model_prediction_latency_seconds_bucket", f'{{"le":"{e}"}}', f"value / 30 <= {e}") for e in LATENCY_EDGES],
    ("model_prediction_latency_seconds_bucket", '{"le":"Infinity"}', "true"),
]
# Gauges: (metric, labels, condition, value).
_GAUGES = [
    ("up", "{}", "event_type = 'view'", "case when value < 100 then 1.0 else 0.0 end"),
    ("infra_redis_connected", "{}", "event_type = 'click'", "case when event_id % 20 = 0 then 0.0 else 1.0 end"),
    ("infra_minio_connected", "{}", "event_type = 'click'", "case when event_id % 30 = 0 then 0.0 else 1.0 end"),
    ("system_cpu_usage_percent", "{}", "event_type = 'error'", "cast(value as double)"),
    ("system_memory_usage_bytes", "{}", "event_type = 'signup'", "value * 268435456.0"),
    ("model_sentiment_confidence_score", "{}", "event_type = 'view'", "event_id % 128 / 128.0e0"),
    ("prometheus_config_last_reload_successful", "{}", "event_type = 'purchase'", "case when event_id % 40 = 0 then 0.0 else 1.0 end"),
    ("model_recsys_predicted_rating", "{}", "event_type = 'signup'", "1.0 + event_id % 5"),
    *[("model_topic_prediction_count", f'{{"topic":"{t}"}}', f"event_type = '{t}'", "cast(value as double)") for t in ("click", "error", "view")],
]


def _union(rows, value: str | None = None) -> str:
    return " union all ".join(
        f"select '{r[0]}' as metric, '{r[1]}' as labels, ts, event_id" + (f", cast({r[3]} as double) as value" if value else "")
        + f" from events where {r[2]}" for r in rows)


def metric_samples(spark, sf):
    """(metric, labels map, ts, value): running counts of events, and gauges set by events."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.createOrReplaceTempView("rule_events")
    c = running_count(spark.sql(_union(_COUNTERS).replace("from events", "from rule_events")), ["metric", "labels"], ["ts", "event_id"])
    factor = F.when(F.col("metric") == "model_load_duration_seconds_sum", MEAN_LOAD).otherwise(1.0)
    c = c.select("metric", "labels", "ts", (F.col("value") * factor).alias("value"))
    g = spark.sql(_union(_GAUGES, "value").replace("from events", "from rule_events")).select("metric", "labels", "ts", "value")
    return c.unionByName(g).withColumn("labels", F.from_json("labels", "map<string,string>"))


_B = f"(epoch_us(ts) + {STEP * 1_000_000 - 1}) // {STEP * 1_000_000} * {STEP}"
add_view_sql("mdelta", f"""select metric, labels, b, sum(d) as d from (
    select metric, labels, {_B} as b, coalesce(value - lag(value) over (partition by metric, labels order by ts, value), 0.0) as d from (
      select metric, labels, ts, case when metric = 'model_load_duration_seconds_sum' then {MEAN_LOAD} else 1.0 end * cast(count(*) over (
        partition by metric, labels order by ts, event_id rows between unbounded preceding and current row) as double) as value
      from ({_union(_COUNTERS)}) u) s) x group by 1, 2, 3""")
for _w in (300, 600, 3600, 7200):
    add_view_sql(f"minc{_w}", f"""select metric, labels, b + j * {STEP} as t, sum(d) as v from mdelta, range(0, {_w // STEP}) r(j)
        group by 1, 2, 3""", ("mdelta",))
add_view_sql("mgauge", f"""select metric, labels, {_B} as t, sum(value) as s, count(*) as n, arg_max(value, (ts, value)) as last
    from ({_union(_GAUGES, "value")}) u group by 1, 2, 3""")
add_view_sql("mavg", f"""select metric, labels, t + j * {STEP} as t, sum(s) / sum(n) as v from mgauge, range(0, 12) r(j)
    group by 1, 2, 3""", ("mgauge",))
add_view_sql("mquant", """with c as (select t, case when json_extract_string(labels, '$.le') = 'Infinity' then 'inf'::double
        else cast(json_extract_string(labels, '$.le') as double) end as le, v as cum from minc300 where metric = 'model_prediction_latency_seconds_bucket'),
      w as (select *, lag(le) over (partition by t order by le) as pl, lag(cum) over (partition by t order by le) as pc,
                   max(cum) over (partition by t) as tot, max(case when le <> 'inf'::double then le end) over (partition by t) as mf from c),
      hit as (select *, row_number() over (partition by t order by le) as rn from w where cum >= 0.95::double * tot)
    select t, case when tot <= 0 then null when le = 'inf'::double then mf
      else coalesce(pl, 0.0) + (le - coalesce(pl, 0.0)) * ((0.95::double * tot - coalesce(pc, 0.0)) / (cum - coalesce(pc, 0.0))) end as v
    from hit where rn = 1""", ("minc300",))


def _of(name: str) -> str:
    kind, metric, matchers, *rest = A.RULE_INPUTS[name]

    def where(m, ms):
        conds = [f"metric = '{m}'"]
        for k, v in ms.items():
            got = f"coalesce(json_extract_string(labels, '$.{k}'), '')"
            conds.append(f"regexp_full_match({got}, '{v[2:]}')" if v.startswith("=~") else f"{got} = '{v}'")
        return " and ".join(conds)

    own = where(metric, matchers)
    if kind in ("gauge", "gib"):
        return f"select labels, t, last / {A.GIB if kind == 'gib' else 1.0} as v from mgauge where {own}"
    if kind == "rate":
        return f"select labels, t, v / 300.0 as v from minc300 where {own}"
    if kind == "increase":
        return f"select labels, t, v from minc600 where {own}"
    if kind == "ratio":
        return (f"select '{{}}' as labels, n.t, case when d.v <> 0 then n.v / d.v end as v from (select t, sum(v) as v from minc300 where {own} group by 1) n "
                f"join (select t, sum(v) as v from minc300 where {where(*rest)} group by 1) d on n.t = d.t")
    if kind == "mean":
        return (f"select n.labels, n.t, case when d.v <> 0 then n.v / d.v end as v from (select * from minc300 where {where(metric + '_sum', matchers)}) n "
                f"join (select * from minc300 where {where(metric + '_count', matchers)}) d on n.labels = d.labels and n.t = d.t")
    if kind in ("avg", "deviation"):
        return f"select labels, t, {'v' if kind == 'avg' else f'abs(v - {A.RATING_TARGET})'} as v from mavg where {own}"
    if kind == "offset":
        return (f"select a.labels, a.t, abs(a.v / 3600.0 - b.v / 7200.0) as v from (select * from minc3600 where {own}) a "
                f"join (select * from minc7200 where {own}) b on a.labels = b.labels and a.t = b.t + 3600")
    if kind == "imbalance":
        return (f"select labels, t, case when m <> 0 then (last - m) / m end as v from (select *, avg(last) over (partition by t) as m "
                f"from mgauge where {own}) x")
    return "select '{}' as labels, t, v from mquant"


add_view_sql("rvalues", "select * from (" + " union all ".join(
    f"select '{n}' as alertname, labels as series, t, cast(v as double) as value from ({_of(n)}) q" for n in A.RULE_INPUTS) + ") z where value is not null",
    ("minc300", "minc600", "minc3600", "minc7200", "mgauge", "mavg", "mquant"))
_RULES = ", ".join(f"('{n}', '{s}', '{op}', {thr}::double, {hold})" for n, s, _, _, op, thr, hold in A.ALERT_RULES)
add_view_sql("rstates", f"""with tr as (select v.*, r.severity, r.hold from rvalues v
      join (values {_RULES}) r(alertname, severity, op, threshold, hold) on v.alertname = r.alertname
      where case op when '>' then value > threshold when '<' then value < threshold else value = threshold end),
    g as (select *, t // {STEP} - row_number() over (partition by alertname, series order by t) as g from tr),
    s as (select *, min(t) over (partition by alertname, series, g) as st, max(t) over (partition by alertname, series, g) as en from g)
    select alertname, severity, series, t, case when t - st >= hold then 'firing' else 'pending' end as state, st as active_since, value from s
    union all
    select alertname, severity, series, max(en) + {STEP}, 'resolved', min(st), null from s where en - st >= hold
    group by alertname, severity, series, g having max(en) + {STEP} <= (select max(t) from rvalues)""", ("rvalues",))


@register("rule_values", with_views("select alertname, series, t, round(value, 9) as value from rvalues", "rvalues"))
def q_rule_values(spark, sf):
    """The expressions of all 20 alert rules."""
    return A.rule_values(metric_samples(spark, sf), STEP).withColumn("value", F.round("value", 9))


@register("rule_states", with_views(
    "select alertname, severity, series, t, state, active_since, round(value, 9) as value from rstates", "rstates"))
def q_rule_states(spark, sf):
    """Pending, firing and resolved rows of all 20 alert rules, in one pass over their values."""
    v = A.rule_values(metric_samples(spark, sf), STEP)
    return A.rule_states(v, STEP).withColumn("value", F.round("value", 9))
