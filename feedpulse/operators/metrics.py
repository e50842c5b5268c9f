"""Metric events from scored rows: validation, counters, histograms, gauges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.functions.text import RATING_FALLBACK, RATING_MAX, RATING_MIN

# Fixed values ---------------------------------------------------------------
# Histogram bucket edges of the exported metrics.
CONFIDENCE_BUCKETS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)
RATING_BUCKETS = (1.0, 2.0, 3.0, 4.0, 5.0)
BATCH_SIZE_BUCKETS = (10, 50, 100, 500, 1000, 5000)
DEFAULT_LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
# Latency edges used on events.value by the canonical fixtures.
EVENT_VALUE_BUCKETS = (5, 10, 25, 50, 100, 250, 500)
# Paths not measured by the request middleware.
UNMEASURED_PATHS = ("/metrics", "/health")
# Metric name filters and static labels of the scrape job.
KEEP_PATTERNS = ("model_.*", "api_.*", "infra_.*", "system_.*", "batch_.*")
DROP_PATTERNS = ("debug_.*", "internal_.*", "_internal_.*")
STATIC_LABELS = {"environment": "production", "instance": "backend-1"}
# Defaults applied to invalid metric inputs.
DEFAULT_CONFIDENCE = 0.5
DEFAULT_TOPIC = "unknown"
# ----------------------------------------------------------------------------


def _num_ok(c: Column) -> Column:
    x = c.try_cast("double")
    return x.isNotNull() & ~F.isnan(x)


def clean_metric_events(df: DataFrame) -> DataFrame:
    """Per-row validation of metric inputs (columns present are cleaned).

    confidence outside 0..1 -> 0.5; rating invalid -> 3.0 else clipped to 1..5;
    topic null/empty -> 'unknown'; processing time < 0 or no number -> 0; batch size <= 0 -> 1;
    no or a non-boolean ``is_cold_start`` -> false; with a ``success`` flag, size and time of failed batches -> null;
    rows with an empty sentiment are dropped; a non-boolean spam flag -> false.
    """
    cols = set(df.columns)
    out = df
    if "sentiment" in cols:
        out = out.where(F.col("sentiment").isNotNull() & (F.col("sentiment") != ""))
    if "confidence" in cols:
        c = F.col("confidence").try_cast("double")
        out = out.withColumn("confidence", F.when(_num_ok(c) & (c >= 0) & (c <= 1), c)
                             .otherwise(F.lit(DEFAULT_CONFIDENCE)))
    if "rating" in cols:
        r = F.col("rating").try_cast("double")
        out = out.withColumn("rating", F.when(_num_ok(r), F.least(F.greatest(r, F.lit(RATING_MIN)), F.lit(RATING_MAX)))
                             .otherwise(F.lit(RATING_FALLBACK)))
    if "topic" in cols:
        out = out.withColumn("topic", F.when(F.col("topic").isNull() | (F.col("topic") == ""), F.lit(DEFAULT_TOPIC))
                             .otherwise(F.col("topic")))
    if "processing_time" in cols:
        t = F.col("processing_time").try_cast("double")
        out = out.withColumn("processing_time", F.when(_num_ok(t), F.greatest(t, F.lit(0.0))).otherwise(F.lit(0.0)))
    if "batch_size" in cols:
        n = F.col("batch_size").try_cast("bigint")
        out = out.withColumn("batch_size", F.when(n > 0, n).otherwise(F.lit(1).cast("bigint")))
    if "is_cold_start" in cols:
        flag = F.lower(F.col("is_cold_start").cast("string"))
        out = out.withColumn("is_cold_start", F.coalesce(flag.isin("true", "1"), F.lit(False)))
    else:
        out = out.withColumn("is_cold_start", F.lit(False))
    if "success" in cols:  # size and latency are measured of batches that succeeded
        ok = F.coalesce(F.col("success"), F.lit(False))
        for c in ("batch_size", "processing_time"):
            if c in cols:
                out = out.withColumn(c, F.when(ok, F.col(c)))
    if "is_spam" in cols:
        is_bool = dict(df.dtypes)["is_spam"] == "boolean"
        out = out.withColumn("is_spam", F.coalesce(F.col("is_spam"), F.lit(False)) if is_bool else F.lit(False))
    return out


def counter(df: DataFrame, labels: Sequence[str], out: str = "value") -> DataFrame:
    """A counter per label set = rows per label combination."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(out))


def histogram(df: DataFrame, value: str, buckets: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``le`` counts (+Inf), sum and count, long form ``(labels, le, cum, sum, count)``.

    One aggregate with a conditional count per edge, then ``stack`` to rows.
    """
    aggs = [F.count_if(F.col(value) <= F.lit(float(b))).alias(f"__le{i}") for i, b in enumerate(buckets)]
    g = df.where(F.col(value).isNotNull()).groupBy(*labels).agg(
        *aggs, F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"))
    pairs = ", ".join([f"cast({float(b)!r} as double), __le{i}" for i, b in enumerate(buckets)]
                      + ["cast('Infinity' as double), count"])
    return g.selectExpr(*labels, "sum", "count", f"stack({len(buckets) + 1}, {pairs}) as (le, cum)")


def gauge(df: DataFrame, labels: Sequence[str], value: str = "value", ts: str = "ts",
          tie: str | None = None) -> DataFrame:
    """I4: the last value of each gauge series (latest ts, ties by ``tie``)."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    return df.groupBy(*labels).agg(F.max_by(value, order).alias(value), F.max(ts).alias("at"))


def throughput(size: Column | str, seconds: Column | str) -> Column:
    """Rows per second; 0 when the time is 0."""
    s = F.col(size) if isinstance(size, str) else size
    t = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(t > 0, s / t).otherwise(F.lit(0.0))


def request_metrics(requests: DataFrame, latency_buckets: Sequence[float] = DEFAULT_LATENCY_BUCKETS):
    """Drop unmeasured paths; request counter by (method, endpoint, status_code) and latency histogram."""
    r = requests.where(~F.col("endpoint").isin(*UNMEASURED_PATHS))
    return counter(r, ["method", "endpoint", "status_code"]), histogram(r, "latency", latency_buckets,
                                                                        ["method", "endpoint"])


def filter_metrics(df: DataFrame, name: str = "metric", keep: Sequence[str] = KEEP_PATTERNS,
                   drop: Sequence[str] = DROP_PATTERNS, static: Mapping[str, str] = STATIC_LABELS) -> DataFrame:
    """Keep names matching a keep pattern and no drop pattern; add static labels."""
    k = "^(?:" + "|".join(keep) + ")$"
    d = "^(?:" + "|".join(drop) + ")$"
    out = df.where(F.col(name).rlike(k) & ~F.col(name).rlike(d))
    for lab, v in static.items():
        out = out.withColumn(lab, F.lit(v))
    return out
