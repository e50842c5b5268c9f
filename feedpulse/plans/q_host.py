"""Host panels (J12) over a metric table derived from the events: memory, disk, network, CPU and uptime."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedpulse.operators import timeseries as J
from feedpulse.operators.ordering import running_count
from feedpulse.plans.q_kpi import round_doubles
from feedpulse.plans.registry import register
from feedpulse.plans.views import add_view_sql, with_views
from feedpulse.sources.tables import table

STEP, W = 900, 3600
K = W // STEP
_HOST = "concat('host', cast(event_id % 3 as varchar(9)))"
# Gauges: (metric, mount point, condition on events, value).
_GAUGES = [
    (J.MEMORY["total"], None, "event_type = 'view'", "16384.0 + event_id % 3 * 1024"),
    (J.MEMORY["free"], None, "event_type = 'view'", "event_id % 4096"),
    (J.MEMORY["buffers"], None, "event_type = 'view' and event_id % 2 = 0", "event_id % 512"),
    (J.MEMORY["cached"], None, "event_type = 'view'", "event_id % 2048"),
    (J.MEMORY["available"], None, "event_type = 'view'", "event_id % 4096 + event_id % 2048"),
    *[(J.DISK[c], m, f"event_type = 'click' and event_id % 2 = {i}", v) for i, m in enumerate(("/", "/data"))
      for c, v in (("size", "case when event_id % 97 = 0 then 0.0 else 65536.0 end"), ("free", "event_id % 65536"), ("avail", "event_id % 60000"))],
    (J.BOOT, None, "event_type = 'signup' and event_id % 5 = 0", "1700000000 + event_id * 60"),
]
# Counters: (metric, mode, device, condition on events, bytes or seconds that an event adds).
_COUNTERS = [
    *[(J.CPU, mode, None, f"event_type = 'error' and event_id % 5 = {i}", "1.0") for i, mode in enumerate(("idle", "user", "system", "iowait", "steal"))],
    *[(m, None, d, f"event_type = 'purchase' and event_id % 2 = {i} and event_id % {4 + j} <> 0", f"{1024.0 * (1 + j)}")
      for i, d in enumerate(("eth0", "eth1")) for j, m in enumerate((J.RECEIVED, J.SENT))],
]


def _lit(x) -> str:
    return "cast(null as varchar(20))" if x is None else f"'{x}'"


def _gauge_sql(src: str) -> str:
    return " union all ".join(f"select '{m}' as metric, {_HOST} as instance, {_lit(None)} as mode, {_lit(None)} as device, {_lit(p)} as mountpoint, "
                              f"ts, cast({v} as double) as value from {src} where {c}" for m, p, c, v in _GAUGES)


def _counter_sql(src: str) -> str:
    return " union all ".join(f"select '{m}' as metric, {_HOST} as instance, {_lit(mode)} as mode, {_lit(d)} as device, {_lit(None)} as mountpoint, "
                              f"ts, event_id, cast({add} as double) as each from {src} where {c}" for m, mode, d, c, add in _COUNTERS)


def host_samples(spark, sf):
    """(metric, instance, mode, device, mountpoint, ts, value): gauges that events set, and running counts of events."""
    table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).createOrReplaceTempView("host_events")
    c = running_count(spark.sql(_counter_sql("host_events")), ["metric", "instance", "mode", "device"], ["ts", "event_id"], out="n")
    c = c.withColumn("value", F.col("n") * F.col("each")).drop("n", "each", "event_id")
    return spark.sql(_gauge_sql("host_events")).unionByName(c)


_B = f"(epoch_us(ts) + {STEP * 1_000_000 - 1}) // {STEP * 1_000_000} * {STEP}"
add_view_sql("hgauge", f"select metric, instance, mountpoint, ts, value, {_B} as b from ({_gauge_sql('events')}) g")
add_view_sql("hcounter", f"""select metric, instance, mode, device, ts, each * count(*) over (partition by metric, instance, mode, device
    order by ts, event_id rows between unbounded preceding and current row) as value from ({_counter_sql('events')}) c""")
add_view_sql("hlast", f"""select metric, instance, mountpoint, t, arg_max(value, (ts, value)) as v from (
    select *, b + j * {STEP} as t from hgauge, range(0, {K}) r(j)) e group by all""", ("hgauge",))
add_view_sql("hrate", f"""select metric, instance, mode, device, b + j * {STEP} as t, sum(d) / {float(W)} as rate from (
    select *, {_B} as b, coalesce(value - lag(value) over (partition by metric, instance, mode, device order by ts, value), 0.0) as d from hcounter) x,
    range(0, {K}) r(j) group by metric, instance, mode, device, b + j * {STEP}""", ("hcounter",))


def _wide(columns: dict) -> str:
    return ", ".join(f"max(case when metric = '{m}' then v end) as {c}" for c, m in columns.items())


@register("host_memory", with_views(f"""select instance, t, total - free - buffers - cached as used, total - available as unavailable,
    round(case when total <> 0 then (total - available) / total * 100 end, 6) as used_pct from (
      select instance, t, {_wide(J.MEMORY)} from hlast where metric like 'node_memory%' group by instance, t) w""", "hlast"))
def q_host_memory(spark, sf):
    return round_doubles(J.host_memory(host_samples(spark, sf), STEP, W))


@register("host_disk", with_views(f"""select instance, mountpoint, t, round(case when size <> 0 then (size - free) / size * 100 end, 6) as used_pct,
    round(case when size <> 0 then (size - avail) / size * 100 end, 6) as unavailable_pct from (
      select instance, mountpoint, t, {_wide(J.DISK)} from hlast where metric like 'node_filesystem%' group by instance, mountpoint, t) w""", "hlast"))
def q_host_disk(spark, sf):
    return round_doubles(J.host_disk(host_samples(spark, sf), STEP, W))


@register("host_network", with_views(f"""select instance, device, t, round(max(case when metric = '{J.RECEIVED}' then rate end), 6) as received,
    round(max(case when metric = '{J.SENT}' then rate end), 6) as sent from hrate where metric like 'node_network%' group by instance, device, t""", "hrate"))
def q_host_network(spark, sf):
    return round_doubles(J.host_network(host_samples(spark, sf), STEP, W))


@register("host_cpu", with_views(f"""select instance, t, round(100 - avg(case when mode = 'idle' then rate end) * 100, 6) as busy_pct,
    round(avg(case when mode not in ('idle', 'iowait', 'steal') then rate end) * 100, 6) as working_modes_pct
    from hrate where metric = '{J.CPU}' group by instance, t""", "hrate"))
def q_host_cpu(spark, sf):
    return round_doubles(J.host_cpu(host_samples(spark, sf), STEP, W))


@register("host_uptime", with_views(f"""with a as (select instance, {_B} as t, case when metric = '{J.BOOT}' then value end as boot, case when metric = '{J.BOOT}' then ts end as seen
      from (select metric, instance, ts, value from hgauge union all select metric, instance, ts, value from hcounter) s),
    g as (select instance, t, arg_max(boot, seen) as boot from a group by instance, t)
    select instance, t, t - last_value(boot ignore nulls) over (partition by instance order by t) as uptime from g""", "hgauge", "hcounter"))
def q_host_uptime(spark, sf):
    return J.host_uptime(host_samples(spark, sf), STEP)
