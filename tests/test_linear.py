"""Block-trained linear models against plain numpy, and as stages of saved pipelines and streams."""

import uuid

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from feedpulse.operators import features as D
from feedpulse.operators import linear as L
from feedpulse.operators import nightly as N
from feedpulse.operators import scoring as SC
from feedpulse.operators import train as TR
from feedpulse.session import scratch_path
from feedpulse.streaming import streams as K


def rows(spark, n=60, terms=12, classes=3, seed=3):
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, terms)), rng.integers(0, classes, n)
    for i in range(n):
        for j in rng.choice(terms, 4, replace=False):
            x[i, j] = rng.normal() + (j % classes == y[i]) * 3
    x[7] = 0  # a row without terms
    data = [(i, Vectors.sparse(terms, {j: float(x[i, j]) for j in np.flatnonzero(x[i])}), int(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(data, ["doc_id", "features", "y"])


def huber(x, y, epochs, alpha=1e-4, eta=0.5):
    """The update rule, row by row."""
    w, b, sign, out = np.zeros(x.shape[1]), 0.0, np.where(y == 1, 1.0, -1.0), []
    for _ in range(epochs):
        z = sign * (x @ w + b)
        out.append(np.where(z >= 1, 0, np.where(z >= -1, (1 - z) ** 2, -4 * z)).mean())
        g = sign * np.where(z >= 1, 0, np.where(z >= -1, -2 * (1 - z), -4))
        w, b = w - eta * (x.T @ g / len(x) + alpha * w), b - eta * g.mean()
    return w, b, out


def test_modified_huber_equals_the_plain_rule(spark):
    x, y, df = rows(spark, classes=2)
    blocks = L.to_blocks(df.repartition(5), "features", F.col("y"))
    w, b, history = L.fit_modified_huber(blocks, x.shape[1], TR.LINEAR_ALPHA, max_epochs=12)
    w0, b0, losses = huber(x, y, 12)
    assert np.allclose(w, w0, atol=1e-9) and b == pytest.approx(b0, abs=1e-9)
    assert [h[0] for h in history] == list(range(1, 13)) and np.allclose([h[1] for h in history], losses, atol=1e-6)
    long = df.select("doc_id", F.explode(F.arrays_zip(*[c.alias(a) for c, a in zip(D.sparse_parts("features"), ("idx", "weight"))])).alias("p")).select("doc_id", "p.*")
    w1, b1, h1 = TR.train_modified_huber(long, df.select("doc_id", "y"), max_epochs=12)
    assert np.allclose([w1.get(i, 0.0) for i in range(len(w0))], w0, atol=1e-9) and np.allclose([h[1] for h in h1], losses, atol=1e-6)


def test_an_epoch_moves_no_row(spark):
    x, _, df = rows(spark)
    blocks = L.to_blocks(df, "features", F.col("y"))
    assert blocks.columns == ["n", "ends", "idx", "val", "y", "valid"] and blocks.agg(F.sum("n")).first()[0] == len(x)
    s = L.evaluate(blocks, np.zeros((3, x.shape[1])), np.zeros(3), "log")
    assert np.allclose(s.loss / s.n, np.log(2)) and s.n == len(x)


def test_joint_fit_equals_separate_fits(spark):
    from pyspark.ml.classification import LogisticRegression
    x, y, df = rows(spark, n=120)
    blocks = L.to_blocks(df, "features", F.col("y"))
    w, b, passes = L.fit_one_vs_rest(blocks, 3, x.shape[1], 0.01, max_iter=200, tol=1e-10)
    for k in range(3):
        m = LogisticRegression(regParam=0.01, standardization=False, maxIter=200, tol=1e-10, labelCol="z").fit(
            df.withColumn("z", (F.col("y") == k).cast("double")))
        assert np.allclose(w[k], m.coefficients.toArray(), atol=1e-3) and b[k] == pytest.approx(m.intercept, abs=1e-3)
    # the number of passes does not follow the number of classes
    many = L.to_blocks(df, "features", F.col("doc_id") % 20)
    _, _, more = L.fit_one_vs_rest(many, 20, x.shape[1], 0.01, max_iter=15)
    assert more <= 15 * 4 and passes < 400


def test_head_is_saved_and_streams(spark):
    text = [(i, ("good nice fine " if i % 2 else "bad awful late ") + ["red", "green", "blue"][i % 3] + f" w{i}",
             ["a", "b", "c"][i % 3], None if i % 5 == 0 else ["neg", "positive"][i % 2]) for i in range(90)]
    df = spark.createDataFrame(text, "doc_id long, clean_text string, topic string, sentiment string")
    model = TR.train_feed(df, TR.TextModelSpec(text_col="clean_text", max_features=60), max_iter=40)
    feed = df.select("doc_id", F.lit("x").alias("topic"), F.col("clean_text").alias("body"))
    got = SC.score_two_heads(feed.drop("topic"), model, "body")
    assert got.columns == ["doc_id", "body", "topic", "topic_confidence", "sentiment", "sentiment_confidence"]
    rows_ = {r["doc_id"]: r for r in got.collect()}
    assert all(rows_[i]["topic"] == t and rows_[i]["sentiment"] == ("Positive" if i % 2 else "Neg") for i, _, t, _ in text)
    root = scratch_path(spark, f"tests/feed-{uuid.uuid4().hex}")
    N.save_version(spark, root, "feed", model, 1)
    assert isinstance(N.load_current(spark, root, "feed"), PipelineModel)

    # four files; the alias moves after two, and the last micro-batch is run again from an older checkpoint
    import os
    src = lambda: K.stream_feed(spark, f"{root}/in", "doc_id long, body string", max_files=1)
    for part in range(4):
        feed.drop("topic").where(F.col("doc_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        assert K.score_available(src(), root, "feed", f"{root}/out", f"{root}/ck", "body") == 1
        if part == 1:
            N.save_version(spark, root, "feed", TR.train_feed(df.withColumn("topic", F.lit("z")), TR.TextModelSpec(text_col="clean_text", max_features=5), max_iter=2), 2)
    local = f"{root}/ck".replace("file:", "")
    os.remove(f"{local}/commits/3")  # as if the driver was lost after the write and before the commit
    if os.path.exists(f"{local}/commits/.3.crc"):
        os.remove(f"{local}/commits/.3.crc")
    K.score_available(src(), root, "feed", f"{root}/out", f"{root}/ck", "body")
    out = spark.read.parquet(f"{root}/out")
    assert sorted(tuple(r) for r in out.drop("batch_id").collect()) == sorted(tuple(r) for r in got.collect())
    assert N.current_version(spark, root, "feed") == 2
    with pytest.raises(LookupError):
        K.pinned_version(spark, f"{root}/empty", "feed", f"{root}/ck2")


def test_vocabulary_and_weights_stay_in_their_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None), (5, ["zz", None])], "doc_id long, toks array<string>")
    voc = D.fit_vocab(docs, "doc_id", "toks")
    assert sorted((r["term"], r["tf"], r["df"]) for r in voc.collect()) == [("a", 2, 1), ("b", 2, 2), ("zz", 1, 1)]
    top = D.fit_vocab(docs, "doc_id", "toks", k=2)
    plan = top._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(term") == 1 and "Exchange hashpartitioning(doc_id" not in plan
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    a = D.tfidf(docs.where("doc_id < 5"), top, "doc_id", "toks", n)
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
    b = D._tfidf_by_join(docs.where("doc_id < 5"), top, "doc_id", "toks", n)
    key = lambda r: (r["doc_id"], r["term"], r["idx"], r["tf"], round(r["weight"], 12))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect())) and a.count() == 3
    assert D.bounded_vocab(voc, 2) is None


def test_two_models_are_fitted_on_rows_read_and_counted_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    text = [(i, f"w{i % 7} w{i % 3} common", ["a", "b"][i % 2], ["neg", "positive", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(text, "doc_id long, clean_text string, topic string, sentiment string")
    tokens = TR.tokenise(df.withColumn("clean_text", seen("clean_text")), TR.TextModelSpec(text_col="clean_text"), ["topic", "sentiment"], again=True)
    for terms in (50, 3):
        spec = TR.TextModelSpec(text_col="clean_text", max_features=terms)
        once, apart = (SC.score_two_heads(df.select("doc_id", "clean_text"), TR.train_feed(x, spec, max_iter=3)) for x in (tokens, df))
        assert sorted(once.collect()) == sorted(apart.collect())
    assert reads.value == 60 and not tokens.counts.isEmpty()


def test_terms_are_counted_in_their_batches(spark, monkeypatch):
    monkeypatch.setattr(D, "COUNTED_TERMS", 5)  # rows are counted a few at a time, a long one alone
    docs = [None, [], ["a", "b", "a", None], ["b"] * 9, [None], ["c", "a", "đ", "a", "c"]] * 3
    got = D.count_terms(spark.createDataFrame([(x,) for x in docs], "t array<string>").coalesce(1), "t")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("a", 12, 6), ("b", 30, 6), ("c", 6, 3), ("đ", 3, 3)]


def test_the_files_of_a_drop_can_be_read_by_many_tasks(spark, tmp_path):
    from feedpulse.plans import q_feed
    d = spark.range(0, 12000, 1, 2).select(F.col("id").alias("doc_id"), F.current_date().alias("date"),
                                          F.concat_ws(" ", *[F.sha2(F.concat(F.lit(str(i)), F.col("id")), 512) for i in range(16)]).alias("clean_text"))
    q_feed.drop(d, str(tmp_path / "in"))
    src = K.stream_feed(spark, str(tmp_path / "in"), "doc_id bigint, date date, clean_text string", max_files=2)
    K.run_by_batch(src.withColumn("task", F.spark_partition_id()), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 12000 and got.select("batch_id", "task").distinct().count() > 2  # one micro-batch of two files
    assert got.select("batch_id").distinct().count() == 1
