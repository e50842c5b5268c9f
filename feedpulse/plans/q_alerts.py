"""Registered alert queries (J13-J16) over the 1 h increase of the event counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedpulse.operators import alerts as A
from feedpulse.operators import timeseries as J
from feedpulse.plans.q_timeseries import KEYS, STEP, W, spark_samples
from feedpulse.plans.registry import register
from feedpulse.plans.views import add_view_sql, with_views
from feedpulse.session import written

# Rules evaluated here: (alertname, severity, threshold on increase[1h], hold seconds).
RULES = [("EventBurst", "warning", 4.0, 1800), ("EventBurst", "critical", 5.0, 1800)]


def _rule_sql(name: str, sev: str, thr: float, hold: int) -> str:
    return f"""(with tr as (select event_type, t, increase from inc1h where increase > {thr}),
      r as (select *, t // {STEP} - row_number() over (partition by event_type order by t) as g from tr),
      r2 as (select *, min(t) over (partition by event_type, g) as st, max(t) over (partition by event_type, g) as en
             from r)
    select event_type, t, case when t - st >= {hold} then 'firing' else 'pending' end as state,
           st as active_since, increase, '{name}' as alertname, '{sev}' as severity, event_type as component from r2
    union all
    select event_type, max(en) + {STEP}, 'resolved', min(st), null, '{name}', '{sev}', event_type from r2
    where en - st >= {hold} group by event_type, g having max(en) + {STEP} <= (select max(t) from inc1h))"""


add_view_sql("alerts", " union all ".join(_rule_sql(*r) for r in RULES), ("inc1h",))


def alert_grid(spark, sf):
    """The expression of the rules on the grid (a row per series and instant), computed once and written."""
    return written(J.increase(spark_samples(spark, sf), KEYS, W, STEP).select(*KEYS, "t", "increase"), "alert-grid")


def _rules():
    return [(name, {"severity": sev}, ">", thr, hold) for name, sev, thr, hold in RULES]


def alert_table(spark, sf, grid=None):
    a = A.alerts_of_rules(grid if grid is not None else alert_grid(spark, sf), KEYS, "increase", _rules(), STEP)
    return a.withColumn("component", F.col("event_type"))


def alert_run_table(spark, sf, grid=None):
    r = A.alert_runs(grid if grid is not None else alert_grid(spark, sf), KEYS, "increase", _rules(), STEP)
    return r.withColumn("component", F.col("event_type"))


@register("alert_states", with_views("select * from alerts", "alerts"))
def q_alert_states(spark, sf):
    return alert_table(spark, sf)


# Labels that the routes tell apart, set by component: errors are drift alerts, sign-ups are of a severity without a route.
_SEVERITY_SQL = "case when component = 'signup' then 'info' else severity end"
_DRIFT_SQL = "case when component = 'error' then 'drift' end"


@register("alert_routes", with_views(
    f"""with a as (select alertname, {_SEVERITY_SQL} as severity, component, t, state, {_DRIFT_SQL} as alert_type
                from alerts where state in ('firing', 'resolved')),
       m as (select a.*, unnest(list_filter([case when severity = 'critical' then 'critical-alerts' when severity = 'warning' then 'warning-alerts' end,
                    case when alert_type = 'drift' then 'drift-alerts' end,
                    case when severity not in ('critical', 'warning') and alert_type is null then 'default' end], lambda x: x is not null)) as receiver from a)
    select alertname, severity, component, t, state, receiver from m""", "alerts"))
def q_alert_routes(spark, sf):
    """Runs are routed as intervals (by severity, the drift route, and the default receiver), then shown by instant."""
    runs = alert_run_table(spark, sf).withColumn("severity", F.expr(_SEVERITY_SQL)).withColumn("alert_type", F.expr(_DRIFT_SQL))
    routed = A.route(runs, A.ROUTES, ["severity", "alert_type"], ["alertname", "severity", "component", "start", "end", "fires_at", "resolved_at"])
    return A.run_instants(routed, STEP).select("alertname", "severity", "component", "t", "state", "receiver")


@register("alert_groups", with_views(
    f"""with f as (select alertname, severity, component, t, count(*) as alerts from alerts where state = 'firing'
                  group by 1, 2, 3, 4),
       g as (select *, t // {STEP} - row_number() over (partition by alertname, severity, component order by t) as gid
             from f),
       s as (select *, min(t) over (partition by alertname, severity, component, gid) as st from g),
       k as (select *, (t - st) // {A.REPEAT_INTERVAL} as kk,
                    lag((t - st) // {A.REPEAT_INTERVAL}) over (partition by alertname, severity, component, gid order by t) as pk
             from s)
    select alertname, severity, component, t as notify_at, alerts from k where pk is null or kk > pk""", "alerts"))
def q_alert_groups(spark, sf):
    """J15 on runs as intervals."""
    return A.group_runs(alert_run_table(spark, sf), STEP)


@register("alert_inhibit", with_views(
    """select * from alerts a where not (severity = 'warning' and exists (
        select 1 from alerts c where c.severity = 'critical' and c.state = 'firing' and c.t = a.t
          and coalesce(c.alertname, '') = coalesce(a.alertname, '') and coalesce(c.component, '') = coalesce(a.component, '')))""",
    "alerts"))
def q_alert_inhibit(spark, sf):
    """The critical runs as intervals against the rows of warnings."""
    grid = alert_grid(spark, sf)
    return A.inhibit(alert_table(spark, sf, grid), runs=alert_run_table(spark, sf, grid))


_ERROR_RULE = next(r for r in A.ALERT_RULES if r[0] == "HighAPIErrorRate")


@register("rule_error_share", with_views(
    f"""with x as (select 'all' as scope, e.t, e.rate / a.rate as share
                  from (select t, rate from rate1h where event_type = 'error') e
                  join (select t, sum(rate) as rate from rate1h group by t) a on e.t = a.t where a.rate <> 0),
       tr as (select * from x where share {_ERROR_RULE[4]} {_ERROR_RULE[5]}),
       r as (select *, t // {STEP} - row_number() over (partition by scope order by t) as g from tr),
       r2 as (select *, min(t) over (partition by scope, g) as st, max(t) over (partition by scope, g) as en from r)
    select scope, t, case when t - st >= {_ERROR_RULE[6]} then 'firing' else 'pending' end as state,
           st as active_since, round(share, 9) as share, '{_ERROR_RULE[0]}' as alertname,
           '{_ERROR_RULE[1]}' as severity from r2
    union all
    select scope, max(en) + {STEP}, 'resolved', min(st), null, '{_ERROR_RULE[0]}', '{_ERROR_RULE[1]}' from r2
    where en - st >= {_ERROR_RULE[6]} group by scope, g having max(en) + {STEP} <= (select max(t) from x)""", "rate1h"))
def q_rule_error_share(spark, sf):
    """A rule of the rule table (5xx share > 5 % held 10 min) bound to the error share of the events."""
    r = J.rate(spark_samples(spark, sf), KEYS, W, STEP)
    num = J.match(r, {"event_type": "error"}).select("t", "rate")
    share = J.ratio(num, J.agg_by(r, [], "rate", "sum"), ["t"], "rate", "rate", out="share") \
        .where(F.col("share").isNotNull()).withColumn("scope", F.lit("all"))
    out = A.evaluate_rule(share, ["scope"], "share", _ERROR_RULE, STEP)
    return out.withColumn("share", F.round("share", 9))
