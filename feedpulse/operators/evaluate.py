"""Evaluation, promotion and run bookkeeping.

Metrics are aggregates over the scored test rows; the confusion table has one
row per (label, prediction) pair, so everything after it is tiny.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Promotion rules (model, metric, operator, threshold).
PROMOTION_RULES = [
    ("sentiment", "accuracy", ">=", 0.6),
    ("topic", "accuracy", ">=", 0.6),
    ("email", "accuracy", ">=", 0.7),
    ("email_tracking", "accuracy", ">=", 0.6),
    ("rating", "rmse", "<", 2.0),
]


def accuracy(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.agg(F.avg(F.when(F.col(pred) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"))


def per_class(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class (zero division -> 0)."""
    conf = df.groupBy(F.col(label).alias("__l"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    t = conf.groupBy(F.col("__l").alias("cls")).agg(
        F.sum("__n").alias("support"), F.sum(F.when(F.col("__l") == F.col("__p"), F.col("__n"))).alias("tp"))
    p = conf.groupBy(F.col("__p").alias("cls")).agg(F.sum("__n").alias("predicted"))
    j = t.join(p, "cls", "full_outer").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1)


def weighted_f1(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """Support-weighted mean of the per-class F1."""
    pc = per_class(df, pred, label)
    return pc.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def regression_metrics(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """RMSE and MAE."""
    e = F.col(pred).cast("double") - F.col(label).cast("double")
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def rules_frame(spark: SparkSession, rules=PROMOTION_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "model string, metric string, op string, threshold double")


def promote(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Join (model, metric, value) with the rule table; ``promote`` is the verdict."""
    j = metrics.join(rules, ["model", "metric"], "inner")
    ok = (F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold"))
           .when(F.col("op") == ">", F.col("value") > F.col("threshold"))
           .when(F.col("op") == "<", F.col("value") < F.col("threshold"))
           .when(F.col("op") == "<=", F.col("value") <= F.col("threshold")))
    return j.withColumn("promote", F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------- run log

RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("params", T.StringType()), T.StructField("started_at", T.TimestampType())])
METRICS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("step", T.LongType())])
ALIAS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("alias", T.StringType()), T.StructField("set_at", T.TimestampType())])


def log_run(spark: SparkSession, root: str, model: str, params: Mapping[str, object],
            metrics: DataFrame | None = None, run_id: str | None = None) -> str:
    """Append one run row and its metrics ``(key, value, step)`` to Parquet tables.

    ``metrics`` is a DataFrame computed by Spark (it is written, not collected).
    """
    import datetime as dt
    run_id = run_id or uuid.uuid4().hex
    now = dt.datetime.fromtimestamp(time.time(), dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(run_id, model, json.dumps(dict(params), sort_keys=True, default=str), now)],
                          RUNS_SCHEMA).write.mode("append").parquet(f"{root}/runs")
    if metrics is not None:
        m = metrics
        if "step" not in m.columns:
            m = m.withColumn("step", F.lit(0).cast("bigint"))
        (m.select(F.lit(run_id).alias("run_id"), F.col("key").cast("string"), F.col("value").cast("double"),
                  F.col("step").cast("bigint"))
          .write.mode("append").parquet(f"{root}/run_metrics"))
    return run_id


def metrics_long(wide: DataFrame) -> DataFrame:
    """One-row metric frame -> (key, value) rows via ``stack``."""
    cols = wide.columns
    expr = "stack({}, {}) as (key, value)".format(
        len(cols), ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols))
    return wide.selectExpr(expr)


def set_alias(spark: SparkSession, root: str, model: str, version: int, alias: str = "production") -> None:
    import datetime as dt
    now = dt.datetime.fromtimestamp(time.time(), dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(model, int(version), alias, now)], ALIAS_SCHEMA) \
         .write.mode("append").parquet(f"{root}/aliases")


def current_model(aliases: DataFrame, alias: str = "production") -> DataFrame:
    """Per model, the version the alias points to now (latest assignment wins)."""
    return (aliases.where(F.col("alias") == alias)
                   .groupBy("model").agg(F.max_by("version", F.struct("set_at", "version")).alias("version")))
