"""Alert state, routing, grouping and inhibition (J13-J16) as DataFrame jobs.

Input is an expression result on the grid: ``(keys..., t, value)``. Runs are found once, in one shuffle
by series; routing, grouping and inhibition work on the runs as intervals (start, fires_at, end), of which
there are far fewer than instants, and intervals become instants for output only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedpulse.session import written

# The alert router configuration (match label, value, receiver,
# continue), the default receiver, grouping labels, repeat interval and the
# inhibition rule.
ROUTES = [
    ("severity", "critical", "critical-alerts", True),
    ("severity", "warning", "warning-alerts", True),
    ("alert_type", "drift", "drift-alerts", True),
]
DEFAULT_RECEIVER = "default"
GROUP_BY = ("alertname", "severity", "component")
REPEAT_INTERVAL = 12 * 3600
INHIBIT_SOURCE = ("severity", "critical")
INHIBIT_TARGET = ("severity", "warning")
INHIBIT_EQUAL = ("alertname", "component")

_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _in_runs(true: DataFrame, keys: Sequence[str], step: int, last: Column, hold: Column) -> DataFrame:
    """Rows where the condition holds, each with its run: ``start``, ``end``, ``fires_at`` (null if the run ends
    before) and ``resolved_at`` (null if it did not fire or its end is not seen). One shuffle by ``keys``."""
    keys = list(keys)
    by = Window.partitionBy(*keys)
    d = true.withColumn("__g", (F.col("t") / F.lit(step)).cast("bigint") - F.row_number().over(by.orderBy("t")))
    run = Window.partitionBy(*keys, "__g")  # rows are together by keys already
    d = d.withColumn("start", F.min("t").over(run)).withColumn("end", F.max("t").over(run))
    fires = F.col("start") + F.ceil(hold / F.lit(step)).cast("bigint") * F.lit(step)
    d = d.withColumn("fires_at", F.when(fires <= F.col("end"), fires))
    return d.withColumn("resolved_at", F.when(F.col("fires_at").isNotNull() & (F.col("end") + step <= last), F.col("end") + F.lit(step)))


def _rules_on(expr: DataFrame, value: str, rules: Sequence[tuple]) -> DataFrame:
    """The rows of ``expr`` under which rules (alertname, labels, op, threshold, hold) hold, a row for each."""
    made = []
    names = sorted({k for r in rules for k in r[1]})
    for name, labels, op, threshold, hold in rules:
        ok = _OPS[op](F.col(value), F.lit(threshold))
        made.append(F.when(ok, F.struct(F.lit(name).alias("alertname"), F.lit(hold).cast("bigint").alias("__hold"),
                                        *[F.lit(labels.get(k)).cast("string").alias(k) for k in names])))
    d = expr.withColumn("__r", F.explode(F.array_compact(F.array(*made))))
    return d.select(*expr.columns, "__r.*")


def _found_runs(expr, keys, value, rules, step, horizon) -> tuple[DataFrame, list[str]]:
    last = F.lit(horizon) if horizon is not None else expr.agg(F.max("t")).scalar()
    true = _rules_on(expr.select(*keys, "t", value), value, rules)
    labels = [c for c in true.columns if c not in (*keys, "t", value, "__hold")]
    return _in_runs(true, [*keys, *labels], step, last, F.col("__hold")), labels


def alerts_of_rules(expr: DataFrame, keys: Sequence[str], value: str, rules: Sequence[tuple], step: int,
                    horizon: int | None = None) -> DataFrame:
    """J13 for several rules (alertname, labels, op, threshold, hold) over one expression, in one pass:
    the rows of ``alerts`` for each of them, with the rules' labels as columns."""
    d, labels = _found_runs(expr, list(keys), value, rules, step, horizon)
    state = F.when(F.col("t") >= F.col("fires_at"), "firing").otherwise("pending")
    live = F.struct(F.col("t").alias("t"), state.alias("state"), F.col(value).alias("v"))
    ended = F.when((F.col("t") == F.col("end")) & F.col("resolved_at").isNotNull(), F.struct(
        F.col("resolved_at").alias("t"), F.lit("resolved").alias("state"), F.lit(None).cast(expr.schema[value].dataType).alias("v")))
    d = d.withColumn("__e", F.explode(F.array_compact(F.array(live, ended))))  # the run's last row also ends it
    return d.select(*keys, "__e.t", "__e.state", F.col("start").alias("active_since"), F.col("__e.v").alias(value), *labels)


def alerts(expr: DataFrame, keys: Sequence[str], value: str, op: str, threshold: float,
           hold: int, step: int, alertname: str, labels: dict[str, str] | None = None,
           horizon: int | None = None) -> DataFrame:
    """Pending / firing per instant, and a ``resolved`` row after a fired run.

    A run is a stretch of consecutive grid instants where the condition holds
    (a missing instant ends it). Inside a run an instant is ``firing`` once
    t - run_start >= hold, else ``pending``. The end of a run is seen at the next
    evaluated instant: no ``resolved`` row lies beyond ``horizon``, by default the
    last instant of the whole expression (of any series).
    """
    out = alerts_of_rules(expr, keys, value, [(alertname, labels or {}, op, threshold, hold)], step, horizon)
    return out.select(*keys, "t", "state", "active_since", value, "alertname", *(labels or {}))


def alert_runs(expr: DataFrame, keys: Sequence[str], value: str, rules: Sequence[tuple], step: int,
               horizon: int | None = None) -> DataFrame:
    """J13 as intervals: a row per run with its rule's labels, ``start``, ``end`` (its last instant), ``fires_at``
    and ``resolved_at`` (null where the run does not fire, or its end is not seen)."""
    d, labels = _found_runs(expr, list(keys), value, rules, step, horizon)
    return d.groupBy(*keys, *labels, "__g").agg(*[F.max(c).alias(c) for c in ("start", "end", "fires_at", "resolved_at")]).drop("__g")


def run_instants(runs: DataFrame, step: int) -> DataFrame:
    """The firing and resolved instants (``t``, ``state``) of the runs that fired."""
    firing = F.transform(F.sequence("fires_at", "end", F.lit(step).cast("bigint")), lambda t: F.struct(t.alias("t"), F.lit("firing").alias("state")))
    ended = F.when(F.col("resolved_at").isNotNull(), F.array(F.struct(F.col("resolved_at").alias("t"), F.lit("resolved").alias("state"))))
    none = F.array().cast("array<struct<t:bigint,state:string>>")
    d = runs.where(F.col("fires_at").isNotNull()).withColumn("__e", F.explode(F.concat(firing, F.coalesce(ended, none))))
    return d.select(*[c for c in runs.columns if c not in ("start", "end", "fires_at", "resolved_at")], "__e.t", "__e.state")


def routes_frame(spark: SparkSession, routes=ROUTES) -> DataFrame:
    rows = [(lab, val, rcv, cont, i) for i, (lab, val, rcv, cont) in enumerate(routes)]
    return spark.createDataFrame(rows, "label string, value string, receiver string, continue boolean, ord int")


def route(alerts_df: DataFrame, routes: DataFrame | Sequence[tuple], label_cols: Sequence[str], id_cols: Sequence[str],
          default: str = DEFAULT_RECEIVER) -> DataFrame:
    """Receivers of each alert row (an instant or a run); every matching route up to the first without
    ``continue``; alerts matching no route go to the default receiver.

    The routes are configuration: they become one expression, and nothing is joined or shuffled.
    """
    if isinstance(routes, DataFrame):
        routes = [(r["label"], r["value"], r["receiver"], r["continue"]) for r in routes.orderBy("ord").collect()]
    found, open_ = [], F.lit(True)
    for label, value, receiver, goes_on in routes:
        hit = F.coalesce(F.col(label).cast("string") == value, F.lit(False)) if label in label_cols else F.lit(False)
        found.append(F.when(open_ & hit, F.lit(receiver)))
        open_ = open_ if goes_on else open_ & ~hit
    got = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return alerts_df.select(*id_cols, F.explode(F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(default)))).alias("receiver"))


def firing_runs(alerts_df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Stretches (``fires_at``, ``end``) of firing instants, by ``keys``; ``alerts`` rows fire at each of their instants."""
    keys = list(keys)
    per = alerts_df.where(F.col("state") == "firing").groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("alerts"))
    g = (F.col("t") / F.lit(step)).cast("bigint") - F.row_number().over(Window.partitionBy(*keys, "alerts").orderBy("t"))
    return per.withColumn("__g", g).groupBy(*keys, "alerts", "__g").agg(F.min("t").alias("fires_at"), F.max("t").alias("end")).drop("__g")


def group_runs(runs: DataFrame, step: int, group_by: Sequence[str] = GROUP_BY, repeat: int = REPEAT_INTERVAL) -> DataFrame:
    """J15 on intervals: notifications per alert group, at the start of each stretch in which the group
    fires without a break, and again each ``repeat`` seconds of it; ``alerts`` is how many fire then.

    A run is two events, a rise and a fall; sums of events by time (combined before the shuffle) give the number
    that fires between two events.
    """
    group_by, weight = list(group_by), F.col("alerts") if "alerts" in runs.columns else F.lit(1)
    events = runs.where(F.col("fires_at").isNotNull()).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group_by],
        F.explode(F.array(F.struct(F.col("fires_at").alias("t"), weight.cast("bigint").alias("n")),
                          F.struct((F.col("end") + step).alias("t"), (-weight).cast("bigint").alias("n")))).alias("e"))
    by = Window.partitionBy(*group_by).orderBy("t")
    e = events.groupBy(*group_by, F.col("e.t").alias("t")).agg(F.sum("e.n").alias("n"))
    e = e.withColumn("alerts", F.sum("n").over(by)).withColumn("until", F.lead("t").over(by))
    e = e.withColumn("was", F.col("alerts") - F.col("n")).where("alerts > 0")
    e = e.withColumn("since", F.max(F.when(F.col("was") == 0, F.col("t"))).over(by))  # the last start up to here
    repeat = max(repeat, step)
    first = F.floor((F.col("t") - step - F.col("since")) / F.lit(repeat)).cast("bigint") + 1
    final = F.floor((F.col("until") - step - F.col("since")) / F.lit(repeat)).cast("bigint")
    e = e.withColumn("k", F.explode(F.when(first <= final, F.sequence(first, final))))
    return e.select(*group_by, (F.col("since") + F.ceil(F.col("k") * repeat / F.lit(step)).cast("bigint") * step).alias("notify_at"), "alerts")


def group_alerts(alerts_df: DataFrame, step: int, group_by: Sequence[str] = GROUP_BY,
                 repeat: int = REPEAT_INTERVAL) -> DataFrame:
    """J15 on rows of ``alerts``: notifications per alert group at the start of a firing stretch of the
    group and again each ``repeat`` seconds while it keeps firing."""
    g = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group_by]
    return group_runs(firing_runs(alerts_df.select(*g, "t", "state"), group_by, step), step, group_by, repeat)


INHIBIT_BUCKET = 86_400  # seconds of an interval that meet in one task


def inhibit(alerts_df: DataFrame, equal: Sequence[str] = INHIBIT_EQUAL, source=INHIBIT_SOURCE, target=INHIBIT_TARGET,
            runs: DataFrame | None = None) -> DataFrame:
    """Drop target alerts while a firing source alert with equal labels exists.

    The sources are intervals: ``runs`` of ``alert_runs``, or (without ``runs``) the firing rows of
    ``alerts_df`` itself as intervals of one instant. They are cut at the borders of time buckets and meet the target
    rows by (labels, bucket); rows that are no targets stay where they are.
    """
    names = [f"__eq_{c}" for c in equal]
    eq = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(equal, names)]
    bucket = lambda t: F.floor(t / F.lit(INHIBIT_BUCKET))
    if runs is None:
        src = alerts_df.where((F.col(source[0]) == source[1]) & (F.col("state") == "firing")).select(
            *eq, F.col("t").alias("__from"), F.col("t").alias("__to")).distinct()
    else:
        src = runs.where((F.col(source[0]) == source[1]) & F.col("fires_at").isNotNull()).select(
            *eq, F.col("fires_at").alias("__from"), F.col("end").alias("__to"))
    src = src.select(*[F.col(n).alias(f"__s{n}") for n in names], "__from", "__to",
                     F.explode(F.sequence(bucket(F.col("__from")), bucket(F.col("__to")))).alias("__sb"))
    is_target = F.coalesce(F.col(target[0]) == target[1], F.lit(False))
    # rows that are no targets meet no source: their bucket is null
    a = alerts_df.select("*", *eq, F.when(is_target, bucket(F.col("t"))).alias("__b"))
    cond = (F.col("__b") == F.col("__sb")) & F.col("t").between(F.col("__from"), F.col("__to"))
    for n in names:
        cond = cond & (F.col(n) == F.col(f"__s{n}"))
    return a.join(src, cond, "left_anti").drop(*names, "__b")


# The alert rules (name, severity, expression shape, metric, operator,
# threshold, hold in seconds). The expression shape names the operator of
# ``timeseries`` that computes the value; metrics are bound by the caller (Q19).
ALERT_RULES = [
    ("ModelServiceDown", "critical", "gauge", "up", "==", 0.0, 60),
    ("HighModelErrorRate", "critical", "rate_5m", "model_prediction_errors_total", ">", 0.1, 300),
    ("ModelLoadFailures", "critical", "increase_10m", "model_load_failure_total", ">", 0.0, 120),
    ("RedisConnectionDown", "critical", "gauge", "infra_redis_connected", "==", 0.0, 60),
    ("MinIOConnectionDown", "critical", "gauge", "infra_minio_connected", "==", 0.0, 60),
    ("HighModelLatency", "warning", "histogram_quantile_0.95_5m", "model_prediction_latency_seconds", ">", 2.0, 600),
    ("LowModelConfidence", "warning", "avg_over_time_1h", "model_sentiment_confidence_score", "<", 0.6, 1800),
    ("HighMemoryUsage", "warning", "gauge_gib", "system_memory_usage_bytes", ">", 8.0, 600),
    ("HighCPUUsage", "warning", "gauge", "system_cpu_usage_percent", ">", 80.0, 900),
    ("HighBatchProcessingFailureRate", "warning", "ratio_5m", "batch_processing_count_total{status=failed}/all", ">", 0.05, 900),
    ("SentimentModelSlow", "warning", "rate_5m", "model_sentiment_prediction_count", "<", 1.0, 600),
    ("EmailModelSpamDetectionIssues", "warning", "ratio_5m", "spam/(spam+ham)", "<", 0.1, 1800),
    ("RecSysHighColdStartRate", "warning", "ratio_5m", "model_recsys_cold_start_total/predictions", ">", 0.5, 1200),
    ("HighAPIRequestRate", "warning", "rate_5m", "api_request_count_total", ">", 100.0, 300),
    ("HighAPIErrorRate", "warning", "ratio_5m", "api_request_count_total{status=~5..}/all", ">", 0.05, 600),
    ("HighModelLoadTime", "warning", "hist_mean_5m", "model_load_duration_seconds", ">", 30.0, 900),
    ("PrometheusConfigurationError", "critical", "gauge", "prometheus_config_last_reload_successful", "==", 0.0, 300),
    ("SentimentTrendAnomaly", "warning", "offset_delta_1h_2h_1h", "model_sentiment_prediction_count{negative}", ">", 0.5, 1800),
    ("TopicClassificationImbalance", "warning", "imbalance", "model_topic_prediction_count", ">", 2.0, 3600),
    ("RecSysRatingDistributionAnomaly", "warning", "target_deviation_3_1h", "model_recsys_predicted_rating", ">", 1.0, 1800),
]


def rules_frame(spark: SparkSession, rules=ALERT_RULES) -> DataFrame:
    return spark.createDataFrame(
        rules, "alertname string, severity string, shape string, metric string, op string, threshold double, "
               "hold long")


def evaluate_rule(expr: DataFrame, keys: Sequence[str], value: str, rule, step: int) -> DataFrame:
    """J13 for one rule row: its operator, threshold and hold applied to a bound expression frame."""
    name, severity, _shape, _metric, op, threshold, hold = rule
    return alerts(expr, keys, value, op, threshold, hold, step, name, {"severity": severity})


# What each rule's expression reads: kind, metric, label matchers, and for a ratio the
# metric and matchers of the denominator.
RULE_INPUTS = {
    "ModelServiceDown": ("gauge", "up", {}),
    "HighModelErrorRate": ("rate", "model_prediction_errors_total", {}),
    "ModelLoadFailures": ("increase", "model_load_failure_total", {}),
    "RedisConnectionDown": ("gauge", "infra_redis_connected", {}),
    "MinIOConnectionDown": ("gauge", "infra_minio_connected", {}),
    "HighModelLatency": ("quantile", "model_prediction_latency_seconds", {}),
    "LowModelConfidence": ("avg", "model_sentiment_confidence_score", {}),
    "HighMemoryUsage": ("gib", "system_memory_usage_bytes", {}),
    "HighCPUUsage": ("gauge", "system_cpu_usage_percent", {}),
    "HighBatchProcessingFailureRate": ("ratio", "batch_processing_count_total", {"status": "failed"}, "batch_processing_count_total", {}),
    "SentimentModelSlow": ("rate", "model_sentiment_prediction_count", {}),
    "EmailModelSpamDetectionIssues": ("ratio", "model_email_prediction_count", {"label": "spam"}, "model_email_prediction_count", {"label": "=~spam|ham"}),
    "RecSysHighColdStartRate": ("ratio", "model_recsys_cold_start_total", {}, "model_recsys_prediction_count", {}),
    "HighAPIRequestRate": ("rate", "api_request_count_total", {}),
    "HighAPIErrorRate": ("ratio", "api_request_count_total", {"status": "=~5.."}, "api_request_count_total", {}),
    "HighModelLoadTime": ("mean", "model_load_duration_seconds", {}),
    "PrometheusConfigurationError": ("gauge", "prometheus_config_last_reload_successful", {}),
    "SentimentTrendAnomaly": ("offset", "model_sentiment_prediction_count", {"sentiment": "negative"}),
    "TopicClassificationImbalance": ("imbalance", "model_topic_prediction_count", {}),
    "RecSysRatingDistributionAnomaly": ("deviation", "model_recsys_predicted_rating", {}),
}
COUNTER_KINDS = ("rate", "increase", "ratio", "mean", "offset", "quantile")
RATING_TARGET, QUANTILE, GIB = 3.0, 0.95, float(1 << 30)


def rule_values(samples: DataFrame, step: int = 300, inputs=None) -> DataFrame:
    """The value of every rule's expression: (alertname, series, t, value).

    ``samples`` is the long metric table (metric, labels map, ts, value). Counters go through one
    pass of reset-adjusted deltas and gauges through one of per-step aggregates; the windows of all
    rules are sums of those. The instants are multiples of ``step``, which divides the rules' windows.
    """
    from functools import reduce

    from feedpulse.operators import timeseries as J
    inputs = RULE_INPUTS if inputs is None else inputs
    keys = ["metric", "labels"]
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))  # maps are no grouping keys
    s = samples.select("metric", text.alias("labels"), "ts", "value")
    names = {m for k in inputs.values() if k[0] in COUNTER_KINDS for m in (k[1], *k[3:4])}
    names = sorted(names | {f"{m}_{x}" for m in names for x in ("sum", "count", "bucket")})
    deltas = J.reset_deltas(s.where(F.col("metric").isin(names)), keys, step).checkpoint(eager=True)
    gauges = s.where(~F.col("metric").isin(names)).withColumn("__b", J.grid_bucket("ts", step)).groupBy(*keys, "__b").agg(
        F.sum("value").alias("s"), F.count("value").alias("n"), F.max_by("value", F.struct("ts", "value")).alias("last")).checkpoint(eager=True)

    def label(name):
        return F.coalesce(F.get_json_object("labels", f"$.{name}"), F.lit(""))

    def some(df, metric, matchers):
        d = df.where(F.col("metric") == metric)
        for name, m in matchers.items():
            d = d.where(label(name).rlike(f"^(?:{m[2:]})$") if m.startswith("=~") else label(name) == m)
        return d

    def increases(metric, matchers, w):
        e = J.expand(some(deltas, metric, matchers), "__b", w, step)
        return e.groupBy("labels", "t").agg(F.sum("d").alias("value"))

    def total(metric, matchers, w):
        return increases(metric, matchers, w).groupBy("t").agg(F.sum("value").alias("value"))

    def over(metric, matchers, w):
        e = J.expand(some(gauges, metric, matchers), "__b", w, step)
        return e.groupBy("labels", "t").agg((F.sum("s") / F.sum("n")).alias("value"))

    def value_of(kind, metric, matchers, *rest):
        if kind in ("gauge", "gib"):
            v = F.col("last") / GIB if kind == "gib" else F.col("last")
            return some(gauges, metric, matchers).select("labels", F.col("__b").alias("t"), v.alias("value"))
        if kind == "rate":
            return increases(metric, matchers, 300).withColumn("value", F.col("value") / 300.0)
        if kind == "increase":
            return increases(metric, matchers, 600)
        if kind == "ratio":
            return J.ratio(total(metric, matchers, 300), total(*rest, 300), ["t"], "value", "value", "value").withColumn("labels", F.lit("{}"))
        if kind == "mean":
            return J.ratio(increases(f"{metric}_sum", matchers, 300), increases(f"{metric}_count", matchers, 300),
                           ["labels", "t"], "value", "value", "value")
        if kind == "avg":
            return over(metric, matchers, 3600)
        if kind == "deviation":
            return over(metric, matchers, 3600).withColumn("value", F.abs(F.col("value") - RATING_TARGET))
        if kind == "offset":
            now = increases(metric, matchers, 3600).select("labels", "t", (F.col("value") / 3600.0).alias("a"))
            old = increases(metric, matchers, 7200).select("labels", (F.col("t") + 3600).alias("t"), (F.col("value") / 7200.0).alias("b"))
            return now.join(old, ["labels", "t"]).select("labels", "t", F.abs(F.col("a") - F.col("b")).alias("value"))
        if kind == "imbalance":
            last = some(gauges, metric, matchers).select("labels", F.col("__b").alias("t"), F.col("last").alias("value"))
            return J.imbalance(last, "labels", "value").withColumnRenamed("imbalance", "value")
        if kind == "quantile":
            b = increases(f"{metric}_bucket", matchers, 300).select(
                "t", F.get_json_object("labels", "$.le").cast("double").alias("le"), F.col("value").alias("cum"))
            b = b.groupBy("t", "le").agg(F.sum("cum").alias("cum"))
            return J.histogram_quantile(b, QUANTILE, []).select("t", F.col("quantile").alias("value")).withColumn("labels", F.lit("{}"))
        raise ValueError(f"unknown kind {kind}")

    parts = [value_of(*spec).select(F.lit(name).alias("alertname"), F.col("labels").alias("series"), "t", F.col("value").cast("double").alias("value"))
             for name, spec in inputs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).where(F.col("value").isNotNull())


def rule_states(values: DataFrame, step: int = 300, rules=ALERT_RULES) -> DataFrame:
    """J13 for all rules in one pass over ``rule_values``, which are written once: the rule table (20 rows) is
    joined, then one set of windows per (alertname, series) finds the runs. A run ends at an evaluated instant of any rule."""
    values = written(values, "rule-values")  # read for the last instant and for the runs, computed once
    last = values.agg(F.max("t")).scalar()
    j = values.join(F.broadcast(rules_frame(values.sparkSession, rules)), "alertname")  # 20 rules
    ok = F.lit(False)
    for op, test in _OPS.items():
        ok = F.when(F.col("op") == op, test(F.col("value"), F.col("threshold"))).otherwise(ok)
    d = _in_runs(j.where(ok), ["alertname", "series", "severity"], step, last, F.col("hold"))
    live = F.struct(F.col("t").alias("t"), F.when(F.col("t") >= F.col("fires_at"), "firing").otherwise("pending").alias("state"), F.col("value").alias("value"))
    ended = F.when((F.col("t") == F.col("end")) & F.col("resolved_at").isNotNull(), F.struct(
        F.col("resolved_at").alias("t"), F.lit("resolved").alias("state"), F.lit(None).cast("double").alias("value")))
    d = d.withColumn("__e", F.explode(F.array_compact(F.array(live, ended))))
    return d.select("alertname", "severity", "series", "__e.t", "__e.state", F.col("start").alias("active_since"), "__e.value")
