"""Range-vector analytics over metric samples on an evaluation grid.

Samples are rows ``(ts, <label columns>, value)``. An evaluation instant t is a
multiple of ``step`` seconds (epoch based); a range ``[w]`` covers (t - w, t].

Work is pre-aggregated to one row per (series, step bucket) before any
expansion to instants, so a window of w multiplies the *aggregated* rows by
w / step, never the raw samples. Counter resets are settled inside time slices of a
series plus a border term from the small table of slices, so a
series holding a third of all samples is still spread over many tasks.

Deviation from the reference's engine, by design: no edge extrapolation; an
instant is reported when at least one sample lies in its range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.operators.ordering import slice_of, spread

US = 1_000_000


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def grid_bucket(ts: str, step: int) -> Column:
    """First grid instant (epoch seconds) at or after ``ts``."""
    s = step * US
    return ((_us(ts) + (s - 1)) / s).cast("bigint") * step  # floor division of non-negative values


def expand(df: DataFrame, bucket: str, w: int, step: int) -> DataFrame:
    """Each bucket row -> the w/step instants whose range contains it (column ``t``)."""
    k = w // step
    return (df.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
              .withColumn("t", F.col(bucket) + F.col("__j") * F.lit(step)).drop("__j"))


def reset_deltas(samples: DataFrame, keys: Sequence[str], step: int, ts: str = "ts",
                 value: str = "value", splits: Sequence[int] | None = None) -> DataFrame:
    """Per-sample reset-adjusted delta: v - prev if v >= prev else v; 0 for a series' first sample.

    Returns per (keys, bucket) rows: ``d`` (sum of deltas) and ``n`` (samples).

    Raw samples move once, to their (series, slice): a slice is a step bucket, cut further at
    ``splits`` (``ordering.time_splits``) where many samples fall into one. Inside a slice the
    samples are summed in order; the border to the slice before is settled on the table of slices.
    """
    keys = list(keys)
    d = samples.select(*keys, ts, value).withColumn("__b", grid_bucket(ts, step))
    d = d.withColumn("__s", slice_of(F.col(ts), splits) if splits else F.lit(0))
    inside = [*keys, "__b", "__s"]
    d = spread(d, inside if splits else inside[:-1])  # a constant is no key of the windows
    prev = F.lag(value).over(Window.partitionBy(*inside).orderBy(ts, value))

    def delta(v, p):
        return F.when(p.isNull(), F.lit(0.0)).when(v >= p, v - p).otherwise(v.cast("double"))

    at = F.struct(ts, value)
    slices = (d.withColumn("__prev", prev).groupBy(*inside)
               .agg(F.sum(delta(F.col(value), F.col("__prev"))).alias("d"), F.count(F.lit(1)).alias("n"),
                    F.min_by(value, at).alias("__first"), F.max_by(value, at).alias("__last")))
    before = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b", "__s"))
    joined = slices.withColumn("d", F.col("d") + delta(F.col("__first"), before))
    return joined.groupBy(*keys, "__b").agg(F.sum("d").alias("d"), F.sum("n").alias("n")) if splits else joined.select(*keys, "__b", "d", "n")


def increase_of(deltas: DataFrame, keys: Sequence[str], w: int, step: int) -> DataFrame:
    """J1 from the step table of ``reset_deltas``."""
    return expand(deltas, "__b", w, step).groupBy(*keys, "t").agg(F.sum("d").alias("increase"), F.sum("n").alias("samples"))


def increase(samples: DataFrame, keys: Sequence[str], w: int, step: int, **kw) -> DataFrame:
    """``increase(x[w])`` per series and instant: (keys, t, increase, samples)."""
    return increase_of(reset_deltas(samples, keys, step, **kw), keys, w, step)


def rate(samples: DataFrame, keys: Sequence[str], w: int, step: int, **kw) -> DataFrame:
    """``rate(x[w])`` = increase / w (per second)."""
    inc = increase(samples, keys, w, step, **kw)
    return inc.select(*keys, "t", (F.col("increase") / F.lit(float(w))).alias("rate"), "samples")


def agg_by(df: DataFrame, by: Sequence[str], value: str, how: str = "sum", out: str | None = None) -> DataFrame:
    """``sum by (labels)`` / ``avg by (labels)`` at each instant."""
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}[how]
    return df.groupBy("t", *by).agg(fn(value).alias(out or value))


def match(df: DataFrame, matchers: Mapping[str, str], labels_map: str | None = None) -> DataFrame:
    """Label matchers; ``"=v"`` exact, ``"!=v"`` not equal, ``"=~re"`` anchored regex, ``"!~re"``.

    Labels are columns, or keys of a ``map<string,string>`` column when ``labels_map`` is given
    (a missing label matches as the empty string, as in the reference's engine).
    """
    for label, m in matchers.items():
        if labels_map:
            c = F.coalesce(F.element_at(F.col(labels_map), F.lit(label)), F.lit(""))
        else:
            c = F.col(label).cast("string")
        if m.startswith("=~"):
            cond = c.rlike(f"^(?:{m[2:]})$")
        elif m.startswith("!~"):
            cond = ~c.rlike(f"^(?:{m[2:]})$")
        elif m.startswith("!="):
            cond = c != m[2:]
        else:
            cond = c == (m[1:] if m.startswith("=") else m)
        df = df.where(cond)
    return df


def bucket_increase(events: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float],
                    w: int, step: int, ts: str = "ts") -> DataFrame:
    """Cumulative histogram buckets ``le`` (plus +Inf, sum, count) as increases over [w].

    Each observation increments every bucket whose edge is >= the value; the
    increase of such a counter over (t-w, t] is the count of observations in the
    range, computed from per-step partial counts.
    """
    keys = list(keys)
    d = events.select(*keys, ts, value).withColumn("__b", grid_bucket(ts, step))
    aggs = [F.count_if(F.col(value) <= F.lit(float(e))).alias(f"__le{i}") for i, e in enumerate(edges)]
    per = d.groupBy(*keys, "__b").agg(*aggs, F.count(F.lit(1)).alias("__cnt"), F.sum(value).alias("__sum"))
    e = expand(per, "__b", w, step)
    sums = [F.sum(f"__le{i}").alias(f"__le{i}") for i in range(len(edges))]
    g = e.groupBy(*keys, "t").agg(*sums, F.sum("__cnt").alias("count"), F.sum("__sum").alias("sum"))
    pairs = ", ".join([f"cast({float(x)!r} as double), cast(__le{i} as double)" for i, x in enumerate(edges)]
                      + ["cast('Infinity' as double), cast(count as double)"])
    return g.selectExpr(*keys, "t", "sum", "count", f"stack({len(edges) + 1}, {pairs}) as (le, cum)")


def histogram_quantile(buckets: DataFrame, q: float, keys: Sequence[str], le: str = "le",
                       cum: str = "cum") -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket.

    Per (keys, t): rank = q * total; the first bucket with cum >= rank; lower
    edge = previous edge (0 for the first); +Inf bucket -> highest finite edge;
    no observations -> null.
    """
    keys = list(keys)
    part = Window.partitionBy(*keys, "t").orderBy(le)
    b = (buckets.withColumn("__prev_le", F.lag(le).over(part))
                .withColumn("__prev_cum", F.lag(cum).over(part))
                .withColumn("__total", F.max(cum).over(Window.partitionBy(*keys, "t")))
                .withColumn("__max_finite", F.max(F.when(F.col(le) != F.lit(float("inf")), F.col(le)))
                            .over(Window.partitionBy(*keys, "t"))))
    rank = F.lit(q) * F.col("__total")
    hit = b.where(F.col(cum) >= rank)
    first = hit.groupBy(*keys, "t").agg(F.min_by(F.struct(*[F.col(c) for c in (
        le, cum, "__prev_le", "__prev_cum", "__total", "__max_finite")]), F.col(le)).alias("s"))
    s = lambda c: F.col("s")[c]
    lower = F.coalesce(s("__prev_le"), F.lit(0.0))
    below = F.coalesce(s("__prev_cum"), F.lit(0.0))
    inside = s(cum) - below
    val = (F.when(s("__total") <= 0, F.lit(None).cast("double"))
            .when(s(le) == F.lit(float("inf")), s("__max_finite"))
            .when((s("__prev_le").isNull()) & (s(le) <= 0), s(le))
            .otherwise(lower + (s(le) - lower) * ((F.lit(q) * s("__total") - below) / inside)))
    return first.select(*keys, "t", val.alias("quantile"))


def hist_mean(h: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rate(sum) / rate(count) (the w cancels); null when no observations."""
    one = h.where(F.col("le") == F.lit(float("inf"))).select(*keys, "t", "sum", "count")
    return one.select(*keys, "t", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).alias("mean"))


def ratio(num: DataFrame, den: DataFrame, on: Sequence[str], value_num: str, value_den: str,
          out: str = "ratio") -> DataFrame:
    """Vector division on matching (t, labels); null when the denominator is 0 or missing."""
    j = num.select(*on, F.col(value_num).alias("__n")).join(den.select(*on, F.col(value_den).alias("__d")), list(on))
    return j.select(*on, F.when(F.col("__d") != 0, F.col("__n") / F.col("__d")).alias(out))


def over_time(samples: DataFrame, keys: Sequence[str], w: int, step: int, how: str = "avg",
              ts: str = "ts", value: str = "value") -> DataFrame:
    """``avg_over_time`` (also sum/count/max/min/last) of gauge samples in (t-w, t]."""
    keys = list(keys)
    d = samples.select(*keys, ts, value).withColumn("__b", grid_bucket(ts, step))
    per = d.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"),
                                       F.max(value).alias("__mx"), F.min(value).alias("__mn"),
                                       F.max_by(value, F.col(ts)).alias("__last"), F.max(ts).alias("__lts"))
    e = expand(per, "__b", w, step)
    g = e.groupBy(*keys, "t").agg(F.sum("__s").alias("__s"), F.sum("__c").alias("__c"),
                                  F.max("__mx").alias("__mx"), F.min("__mn").alias("__mn"),
                                  F.max_by("__last", "__lts").alias("__last"))
    out = {"avg": F.col("__s") / F.col("__c"), "sum": F.col("__s"), "count": F.col("__c"),
           "max": F.col("__mx"), "min": F.col("__mn"), "last": F.col("__last")}[how]
    return g.select(*keys, "t", out.alias(f"{how}_over_time"))


def offset_delta(samples: DataFrame, keys: Sequence[str], w1: int, w2: int, offset: int, step: int, **kw) -> DataFrame:
    """``abs(rate(x[w1]) - rate(x[w2] offset o))`` at each instant where both exist.

    One pass: a step's row goes to the instants of either window once, and both are summed together.
    """
    deltas = reset_deltas(samples, keys, step, **kw)
    j, o = F.col("__j"), offset // step
    near, far = j < w1 // step, (j >= o) & (j < o + w2 // step)
    rows = deltas.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(max(w1 // step, o + w2 // step) - 1)))).where(near | far)
    both = rows.groupBy(*keys, (F.col("__b") + j * F.lit(step)).alias("t")).agg(
        (F.sum(F.when(near, F.col("d"))) / F.lit(float(w1))).alias("a"), (F.sum(F.when(far, F.col("d"))) / F.lit(float(w2))).alias("b"))
    return both.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*keys, "t", F.abs(F.col("a") - F.col("b")).alias("delta"))


def imbalance(inst: DataFrame, label: str, value: str) -> DataFrame:
    """(x - avg over labels) / avg over labels, per instant.

    The window partitions by instant over already-aggregated rows (one per label).
    """
    m = F.avg(value).over(Window.partitionBy("t"))
    return inst.select(label, "t", F.when(m != 0, (F.col(value) - m) / m).alias("imbalance"))


def target_deviation(df: DataFrame, value: str, target: float) -> DataFrame:
    """``abs(x - target)``."""
    return df.withColumn("deviation", F.abs(F.col(value) - F.lit(target)))


def busy_pct(part_rate: DataFrame, total_rate: DataFrame, on: Sequence[str], part: str, total: str) -> DataFrame:
    """utilisation = 100 * (1 - idle / total) on matching instants."""
    r = ratio(part_rate, total_rate, on, part, total, "__idle_share")
    return r.select(*on, (F.lit(100.0) * (F.lit(1.0) - F.col("__idle_share"))).alias("busy_pct"))


# Dashboard status bands (value below the first edge is green).
LATENCY_BANDS = ((0.5, "yellow"), (2.0, "red"))


def band(df: DataFrame, value: str, thresholds: Sequence[tuple[float, str]] = LATENCY_BANDS,
         base: str = "green", out: str = "status") -> DataFrame:
    """Map a value to the colour of the highest threshold it reaches."""
    c = F.lit(base)
    for edge, name in thresholds:
        c = F.when(F.col(value) >= F.lit(edge), F.lit(name)).otherwise(c)
    return df.withColumn(out, F.when(F.col(value).isNull(), F.lit(None)).otherwise(c))


def record(df: DataFrame, path: str, name: str) -> DataFrame:
    """Materialise a recorded series as Parquet (partitioned by name) and read it back."""
    df.withColumn("record", F.lit(name)).write.mode("overwrite").partitionBy("record").parquet(path)
    return df.sparkSession.read.parquet(path).where(F.col("record") == name).drop("record")


def avg_over_time(samples: DataFrame, keys: Sequence[str], w: int, step: int, **kw) -> DataFrame:
    """J8 under its PromQL name."""
    return over_time(samples, keys, w, step, "avg", **kw)


def used_pct(used: Column | str, total: Column | str) -> Column:
    """Memory or disk used / total in % (null when the total is 0)."""
    u = F.col(used) if isinstance(used, str) else used
    t = F.col(total) if isinstance(total, str) else total
    return F.when(t != 0, u / t * 100)


def uptime(t: Column | str, boot_epoch: Column | str) -> Column:
    """Seconds since boot at instant t."""
    tt = F.col(t) if isinstance(t, str) else t
    b = F.col(boot_epoch) if isinstance(boot_epoch, str) else boot_epoch
    return tt - b


def utilisation(idle_rate: DataFrame, total_rate: DataFrame, on: Sequence[str], idle: str, total: str) -> DataFrame:
    """CPU busy % from idle and total time rates (``busy_pct``)."""
    return busy_pct(idle_rate, total_rate, on, idle, total)


def wide_gauges(samples: DataFrame, labels: Sequence[str], columns: Mapping[str, str], step: int, lookback: int,
                metric: str = "metric", ts: str = "ts", value: str = "value") -> DataFrame:
    """Several gauges joined by their labels: at each instant the last value of each metric in (t - lookback, t].

    ``columns`` names the column of each metric. One aggregate per step, one over the instants: the metrics become
    columns by conditional aggregates, so nothing is joined. A metric without a sample in the range is null.
    """
    labels = list(labels)
    per = (samples.where(F.col(metric).isin(list(columns.values()))).withColumn("__b", grid_bucket(ts, step))
                  .groupBy(*labels, metric, "__b").agg(F.max_by(value, F.struct(ts, value)).alias("__v"), F.max(ts).alias("__at")))
    of = lambda m: F.col(metric) == m
    return expand(per, "__b", lookback, step).groupBy(*labels, "t").agg(
        *[F.max_by(F.when(of(m), F.col("__v")), F.when(of(m), F.col("__at"))).alias(c) for c, m in columns.items()])


# The exported metric names that the host panels read.
MEMORY = {"total": "node_memory_MemTotal_bytes", "free": "node_memory_MemFree_bytes", "buffers": "node_memory_Buffers_bytes",
          "cached": "node_memory_Cached_bytes", "available": "node_memory_MemAvailable_bytes"}
DISK = {"size": "node_filesystem_size_bytes", "free": "node_filesystem_free_bytes", "avail": "node_filesystem_avail_bytes"}
RECEIVED, SENT = "node_network_receive_bytes_total", "node_network_transmit_bytes_total"
CPU, BOOT = "node_cpu_seconds_total", "node_boot_time_seconds"
QUIET_MODES = ("idle", "iowait", "steal")


def host_memory(samples: DataFrame, step: int, lookback: int) -> DataFrame:
    """Memory in use per instance and instant: without buffers and caches, by availability, and in % of the total."""
    w = wide_gauges(samples, ["instance"], MEMORY, step, lookback)
    in_use = F.col("total") - F.col("available")
    return w.select("instance", "t", (F.col("total") - F.col("free") - F.col("buffers") - F.col("cached")).alias("used"),
                    in_use.alias("unavailable"), used_pct(in_use, F.col("total")).alias("used_pct"))


def host_disk(samples: DataFrame, step: int, lookback: int) -> DataFrame:
    """Disk use per instance, mount point and instant, in %: by free and by available space."""
    w = wide_gauges(samples, ["instance", "mountpoint"], DISK, step, lookback)
    return w.select("instance", "mountpoint", "t", used_pct(F.col("size") - F.col("free"), F.col("size")).alias("used_pct"),
                    used_pct(F.col("size") - F.col("avail"), F.col("size")).alias("unavailable_pct"))


def host_network(samples: DataFrame, step: int, w: int, **kw) -> DataFrame:
    """Bytes received and sent per second, by instance and device; both counters go through one pass."""
    keys = ["instance", "device"]
    r = rate(samples.where(F.col("metric").isin(RECEIVED, SENT)), [*keys, "metric"], w, step, **kw)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("rate")))
    return r.groupBy(*keys, "t").agg(of(RECEIVED).alias("received"), of(SENT).alias("sent"))


def host_cpu(samples: DataFrame, step: int, w: int, **kw) -> DataFrame:
    """CPU use per instance and instant, in %: all but idle time, and the mean of the working modes."""
    r = rate(samples.where(F.col("metric") == CPU), ["instance", "mode"], w, step, **kw)
    idle = F.avg(F.when(F.col("mode") == "idle", F.col("rate")))
    work = F.avg(F.when(~F.col("mode").isin(*QUIET_MODES), F.col("rate")))
    return r.groupBy("instance", "t").agg((100 - idle * 100).alias("busy_pct"), (work * 100).alias("working_modes_pct"))


def host_uptime(samples: DataFrame, step: int) -> DataFrame:
    """Seconds since boot at each instant at which the instance has a sample of any metric; the boot time
    last seen is carried forward, however long ago that was (null before the first)."""
    at = samples.withColumn("t", grid_bucket("ts", step)).groupBy("instance", "t").agg(
        F.max_by(F.when(F.col("metric") == BOOT, F.col("value")), F.when(F.col("metric") == BOOT, F.col("ts"))).alias("__boot"))
    carried = F.last("__boot", ignorenulls=True).over(Window.partitionBy("instance").orderBy("t"))  # a row per instant
    return at.select("instance", "t", uptime("t", carried).alias("uptime"))
