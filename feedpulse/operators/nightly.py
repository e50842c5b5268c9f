"""The nightly chain of a model (text, e-mail or rating): split, fit, score, evaluate, promote, log, alias, load by alias.

The predictions of the held-out rows are written, and every metric is an aggregate over that table,
so it can be computed again from it. A version is saved under ``root`` with its run; the alias
``production`` moves to it only if the promotion rule of the model holds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedpulse.operators import evaluate as E
from feedpulse.operators import train as TR
from feedpulse.operators.split import split_random, split_stratified


def _paths(root: str, name: str, version: int) -> tuple[str, str]:
    return f"{root}/models/{name}/v{version}", f"{root}/predictions/{name}/v{version}"


def next_version(spark: SparkSession, root: str, name: str) -> int:
    """One more than the highest version that a run of the model has logged."""
    try:
        runs = spark.read.schema(E.RUNS_SCHEMA).parquet(f"{root}/runs")
        last = runs.where(F.col("model") == name).agg(F.max(F.get_json_object("params", "$.version").cast("int"))).first()[0]
    except Exception as e:  # no run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return (last or 0) + 1


def nightly_run(train: DataFrame, test: DataFrame, name: str, root: str, fit: Callable, save: Callable, load: Callable,
                predict: Callable, metrics_of: Callable, params: Mapping[str, object] | None = None) -> DataFrame:
    """The chain for any model; one row per metric: model, version, metric, value, promote, is_current.

    ``fit(train)``, ``save(model, path)``, ``load(spark, path)``; ``predict(model, test)`` gives the rows that are
    written, with ``label`` and ``prediction``; ``metrics_of(predictions)`` one row with a column per metric.
    """
    spark = train.sparkSession
    version = next_version(spark, root, name)
    model_path, pred_path = _paths(root, name, version)
    save(fit(train), model_path)
    predict(load(spark, model_path), test).write.parquet(pred_path)
    metrics = E.metrics_long(metrics_of(spark.read.parquet(pred_path)))
    E.log_run(spark, root, name, {**(params or {}), "version": version}, metrics)
    judged = E.promote(metrics.select(F.lit(name).alias("model"), F.col("key").alias("metric"), "value"), E.rules_frame(spark))
    ok = [r["promote"] for r in judged.collect()]  # one row per promotion rule of the model
    if ok and all(ok):
        E.set_alias(spark, root, name, version)
    now = current_version(spark, root, name)
    return metrics.select(F.lit(name).alias("model"), F.lit(version).alias("version"), F.col("key").alias("metric"), "value",
                          F.lit(bool(ok) and all(ok)).alias("promote"), F.lit(now == version).alias("is_current"))


def classes_metrics(pred: DataFrame) -> DataFrame:
    return E.accuracy(pred).select("accuracy", E.weighted_f1(pred).select("weighted_f1").scalar().alias("weighted_f1"))


def nightly_text(rows: DataFrame, name: str, spec: TR.TextModelSpec, root: str, doc: str = "doc_id", label: str = "label",
                 fit: Callable | None = None, test_frac: float = 0.2, seed: int = 42,
                 params: Mapping[str, object] | None = None) -> DataFrame:
    """The chain of a text model that is a fitted pipeline (sentiment, topic)."""
    s = split_stratified(rows, [doc], label, test_frac, seed)
    return nightly_run(
        s.where(~F.col("is_test")), s.where("is_test"), name, root, lambda d: (fit or TR.train_logistic)(d, spec),
        TR.save_model, lambda _, path: TR.load_model(path),
        lambda m, d: m.transform(d).select(doc, F.col(label).alias("label"), F.col("predicted_label").alias("prediction")),
        classes_metrics, {**(params or {}), "test_frac": test_frac, "seed": seed})


def nightly_email(rows: DataFrame, spec: TR.TextModelSpec, root: str, name: str = "email", epochs: int = 30, test_frac: float = 0.2,
                  seed: int = 42, params: Mapping[str, object] | None = None) -> DataFrame:
    """The chain of the e-mail model: modified Huber with early stopping on a tenth of the training rows."""
    s = split_stratified(rows, [spec.doc_col], spec.label_col, test_frac, seed)
    return nightly_run(
        s.where(~F.col("is_test")), s.where("is_test"), name, root, lambda d: TR.train_linear(d, spec, "modified_huber", epochs),
        lambda m, path: m.save(path), TR.LinearTextModel.load,
        lambda m, d: m.transform(d).select(spec.doc_col, F.col(spec.label_col).cast("int").alias("label"), "prediction"),
        classes_metrics, {**(params or {}), "epochs": epochs, "test_frac": test_frac, "seed": seed})


def nightly_rating(rows: DataFrame, keys: list[str], root: str, name: str = "rating", trees: int = TR.GBT_TREES, test_frac: float = 0.2,
                   seed: int = 42, params: Mapping[str, object] | None = None) -> DataFrame:
    """The chain of the rating model: id dictionaries, boosted trees, RMSE and MAE of the held-out ratings."""
    s = split_random(rows, keys, test_frac, seed)
    return nightly_run(
        s.where(~F.col("is_test")), s.where("is_test"), name, root, lambda d: TR.RatingModel.fit(d, keys, trees),
        lambda m, path: m.save(path), TR.RatingModel.load,
        lambda m, d: m.score(d.withColumn("label", F.col("rating").cast("double"))).select("label", F.col("predicted_rating").alias("prediction"), "is_cold_start"),
        E.regression_metrics, {**(params or {}), "trees": trees, "test_frac": test_frac, "seed": seed})


def current_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The version that the alias points to; None before the first promotion."""
    try:
        aliases = spark.read.schema(E.ALIAS_SCHEMA).parquet(f"{root}/aliases")
        row = E.current_model(aliases.where(F.col("model") == name)).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    return row and row["version"]


def load_current(spark: SparkSession, root: str, name: str):
    """The model that the alias points to."""
    version = current_version(spark, root, name)
    if version is None:
        raise LookupError(f"no promoted version of {name}")
    return load_version(spark, root, name, version)


def load_version(spark: SparkSession, root: str, name: str, version: int):
    """A saved version, whether the alias points to it or not."""
    return TR.load_model(_paths(root, name, version)[0])


def save_version(spark: SparkSession, root: str, name: str, model, version: int, promote: bool = True) -> None:
    """Save a version fitted elsewhere, and point the alias to it if ``promote``."""
    TR.save_model(model, _paths(root, name, version)[0])
    if promote:
        E.set_alias(spark, root, name, version)


def predictions(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(_paths(root, name, version)[1])
