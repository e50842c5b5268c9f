"""Splits leave rows where they are; kernels of the linear models; sorts of long rows are spread."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedpulse.operators import linear as L
from feedpulse.operators.ordering import spread
from feedpulse.operators.timeseries import reset_deltas
from feedpulse.operators.split import key_hash, split_stratified


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_moves_no_text_and_is_exact(spark):
    rows = [(i, (None, "a", "b", "c")[i % 7 % 4], f"text {i}") for i in range(700)]
    d = spark.createDataFrame(rows, "k long, label string, text string")
    got = split_stratified(d, ["k"], "label", 0.2, 42)
    assert "hashpartitioning" not in _plan(got) and "Window" not in _plan(got)
    w = Window.partitionBy("label").orderBy(key_hash(["k"], 42), "k")
    want = d.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    want = {r["k"] for r in want.where(F.col("r") <= F.ceil(F.col("n") * 0.2)).collect()}
    assert {r["k"] for r in got.where("is_test").collect()} == want and got.count() == 700


def test_split_with_equal_keys_takes_the_share(spark):
    d = spark.createDataFrame([(i // 40, "a" if i < 400 else None, i) for i in range(800)], "k long, label string, text long")
    got = split_stratified(d, ["k"], "label", 0.23, 42).groupBy("label").agg(F.count_if("is_test").alias("n"), F.count(F.lit(1)).alias("all"))
    assert {(r["label"], r["n"], r["all"]) for r in got.collect()} == {("a", 92, 400), (None, 92, 400)}


def test_margins_are_one_product_for_a_batch(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((50, 30)) < 0.2, rng.random((50, 30)), 0.0)
    x[7] = 0.0
    d = spark.createDataFrame([(i, Vectors.sparse(30, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist())) for i, r in enumerate(x)], ["k", "features"])
    for classes in (1, 2, 6):
        w, b = rng.standard_normal((classes, 30)), rng.standard_normal(classes)
        got = d.select("k", L.margins("features", w, b).alias("m"))
        assert "ArrowEvalPython" in _plan(got)
        assert np.allclose([r["m"] for r in sorted(got.collect())], x @ w.T + b)
    y = rng.integers(0, 6, 50)
    blocks = L.to_blocks(d.withColumn("y", F.get(F.lit([int(v) for v in y]), F.col("k").cast("int"))), "features", F.col("y"))
    w, b = rng.standard_normal((6, 30)), rng.standard_normal(6)
    sums = L.evaluate(blocks, w, b, "log")
    sign = np.where(y[:, None] == np.arange(6), 1.0, -1.0)
    z = sign * (x @ w.T + b)
    assert np.allclose(sums.grad, (-sign / (1 + np.exp(z))).T @ x) and np.allclose(sums.loss, np.logaddexp(0, -z).sum(axis=0))


def test_spread_is_not_merged_by_compressed_size(spark):
    d = spark.range(1000).select((F.col("id") % 50).alias("k"), F.lit("a long text " * 20).alias("t"))
    ranked = spread(d, ["k"]).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert ranked.select(F.spark_partition_id().alias("p")).distinct().count() == 8


def test_reset_deltas_sort_spread_rows_only(spark):
    d = spark.range(200).select(F.concat(F.lit("m"), F.col("id") % 2).alias("metric"), F.timestamp_seconds(F.col("id") * 40).alias("ts"), F.col("id").cast("double").alias("value"))
    plan = _plan(reset_deltas(d, ["metric"], 300))
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning(metric") == 2  # the other one has a row per slice
