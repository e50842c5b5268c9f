"""Model fitting (E3-E7, E14) on Spark ML, plus a modified-Huber linear trainer.

Text features come from the fitted vocabulary (at most ``max_features``
terms), so every model's weight vector has a proven size bound.
"""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpulse.functions import text as X
from feedpulse.operators import features as D
from feedpulse.operators import linear as L
from feedpulse.operators.trees import fit_trees
from feedpulse.session import setting, written

# Model sizes and hyper-parameters of the training jobs.
SENTIMENT_TERMS = 3000
TOPIC_TERMS = 5000
EMAIL_TERMS, EMAIL_MIN_DF = 5000, 5
RATING_TERMS = 500
LINEAR_ALPHA = 1e-4
GBT_TREES, GBT_RATE, GBT_DEPTH = 100, 0.1, 5
# Pieces of a rating fit, whose rows are costly and compress well: by Spark's default sizes there are hardly more tasks than cores.
SMALL_PIECES = {"spark.sql.files.maxRecordsPerFile": "500000", "spark.sql.files.maxPartitionBytes": str(32 << 20),
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 << 20)}


def _token_stages(text_col: str, out: str, stop: bool, grams: int) -> list:
    """Tokens, stop words and n-grams as pipeline stages, so the fitted pipeline carries them."""
    pat = D.TOKEN_PATTERN.replace(chr(92), chr(92) * 2)
    raw = out if not (stop or grams > 1) else "__raw_tokens"
    stages = [SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce(`{text_col}`, '')), "
                                       f"'{pat}', 1) AS `{raw}` FROM __THIS__")]
    cur = raw
    if stop:
        nxt = out if grams == 1 else "__stop_tokens"
        stages.append(D.stop_remover(cur, nxt))
        cur = nxt
    if grams == 2:
        t = f"`{cur}`"
        stages.append(SQLTransformer(statement=(
            f"SELECT *, concat({t}, slice(transform(arrays_zip(slice({t}, 1, 1073741824), "
            f"slice({t}, 2, 1073741824)), s -> concat_ws(' ', s['0'], s['1'])), 1, greatest(size({t}) - 1, 0))) "
            f"AS `{out}` FROM __THIS__")))
    return stages


@dataclass
class TextModelSpec:
    text_col: str = "text"
    label_col: str = "label"
    doc_col: str = "doc_id"
    max_features: int = SENTIMENT_TERMS
    min_df: int = 1
    stop: bool = False
    grams: int = 1
    extra: dict = field(default_factory=dict)


@dataclass
class TokenRows:
    """Rows cleaned, tokenised and counted once, for all models that are fitted on them."""
    stages: list
    rows: DataFrame
    counts: DataFrame
    n_docs: int


def tokenise(df: DataFrame, spec: TextModelSpec, keep=(), again: bool = False) -> TokenRows:
    """``df`` as a table of ``keep`` and tokens; the counts of all terms are a table too if they are used ``again``."""
    toks = Pipeline(stages=_token_stages(spec.text_col, "__tokens", spec.stop, spec.grams)).fit(df)
    cols = list(dict.fromkeys([*keep, spec.doc_col]))
    rows = written(toks.transform(df.select(*dict.fromkeys([*cols, spec.text_col]))).select(*cols, "__tokens"), "tokens")
    counts = D.count_terms(rows, "__tokens")
    return TokenRows(list(toks.stages), rows, written(counts, "term-counts") if again else counts, rows.count())


def fit_text_features(df: DataFrame | TokenRows, spec: TextModelSpec, keep=(), widen=None):
    """Fit the vocabulary on ``df``: (stages, n_docs, weighted).

    The rows are read, cleaned and tokenised once and written, unless they come so; vocabulary, number of documents and
    ``weighted`` (the columns ``keep`` and the vector ``features`` of every row) come from that table.
    ``widen`` may add columns to it, which are kept.
    """
    t = df if isinstance(df, TokenRows) else tokenise(df, spec, keep)
    vocab = written(D.pick_terms(t.counts, spec.min_df, spec.max_features), "vocab")
    vectors = D.vectorizer_stages(vocab, "__tokens", "features", t.n_docs)
    wide = widen(t.rows) if widen else t.rows
    kept = [*keep, *[c for c in wide.columns if c not in t.rows.columns]]
    return [*t.stages, *vectors], t.n_docs, PipelineModel(vectors).transform(wide).select(*kept, "features")


def train_logistic(train: DataFrame, spec: TextModelSpec, max_iter: int = 100) -> PipelineModel:
    """Tf-idf + logistic regression, L2 with C = 1 (regParam = 1 / n), no standardisation."""
    stages, n, weighted = fit_text_features(train, spec, [spec.label_col])
    si = StringIndexer(inputCol=spec.label_col, outputCol="__y", stringOrderType="alphabetAsc").fit(weighted)
    lr = LogisticRegression(featuresCol="features", labelCol="__y", regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=si.labels)
    return PipelineModel([*stages, si, lr.fit(si.transform(weighted)), back])


def train_linear_log(train: DataFrame, spec: TextModelSpec, max_iter: int = 100) -> PipelineModel:
    """One binary log-loss linear model per class (one-vs-rest), alpha = 1e-4.

    All classes are fitted together, one pass over the blocks per trial (``linear.fit_one_vs_rest``);
    probabilities are the per-class sigmoids normalised to sum 1.
    """
    stages, _, weighted = fit_text_features(train, spec, [spec.label_col])
    head = fit_head(weighted, spec.label_col, len(stages[-3].vocabulary), LINEAR_ALPHA, max_iter)
    return PipelineModel([*stages, head])


def fit_head(weighted: DataFrame, label: str, terms: int, reg: float, max_iter: int, prefix: str = "") -> L.LinearHead:
    """A fitted head for the labels of ``weighted`` (vectors in ``features``); rows without a label are left out."""
    labels = sorted(r[0] for r in weighted.select(label).where(F.col(label).isNotNull()).distinct().collect())  # one row per class
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1 if labels else F.lit(None)
    blocks = L.to_blocks(weighted, "features", number)
    w, b, _ = L.fit_one_vs_rest(blocks, len(labels), terms, reg, max_iter)
    return L.head_of(w, b, labels, prefix=prefix)


def train_feed(rows: DataFrame | TokenRows, spec: TextModelSpec, topic_col: str = "topic", sentiment_col: str = "sentiment",
               max_iter: int = 50) -> PipelineModel:
    """one fitted pipeline with two heads, topic and sentiment, over one tokenise and weight pass.

    The vocabulary and the weights are fitted on all ``rows``; each head on the rows that have its label
    (null labels are left out). The heads' columns are ``topic_*`` and ``sentiment_*``, so that one
    transform adds both; the fitted pipeline needs the text column only, and works on streams.
    """
    stages, _, weighted = fit_text_features(rows, spec, [topic_col, sentiment_col])
    terms = len(stages[-3].vocabulary)
    weighted = written(weighted, "weighted")  # read by both heads
    known = max(weighted.where(F.col(sentiment_col).isNotNull()).count(), 1)
    return PipelineModel([*stages, fit_head(weighted, topic_col, terms, LINEAR_ALPHA, max_iter, "topic_"),
                          fit_head(weighted, sentiment_col, terms, 1.0 / known, max_iter, "sentiment_")])


def train_gbt(train: DataFrame, spec: TextModelSpec, trees: int = GBT_TREES, id_cols=("user_idx", "item_idx")):
    """Gradient-boosted rating regressor on tf-idf of the description + numeric ids."""
    stages, _, weighted = fit_text_features(train, spec, [spec.label_col, *id_cols])
    return _boosted(stages, weighted, spec.label_col, trees, id_cols)


def _boosted(stages: list, weighted: DataFrame, label: str, trees: int, id_cols=("user_idx", "item_idx")) -> PipelineModel:
    asm = D.assemble("features", tuple(id_cols), "x")
    features = len(stages[-3].vocabulary) + len(id_cols)
    return PipelineModel([*stages, asm, fit_trees(asm.transform(weighted), "x", label, features, trees, GBT_RATE, GBT_DEPTH)])


@dataclass
class RatingModel:
    """E7 with what scoring needs: the fitted pipeline and the two id dictionaries."""
    pipeline: PipelineModel
    users: DataFrame
    items: DataFrame

    @staticmethod
    def fit(rows: DataFrame, keys: list[str], trees: int = GBT_TREES) -> "RatingModel":
        """``rows``: user_id, item_id, rating, the description fields, and ``keys`` that name a row."""
        tr = rows if "text" in rows.columns else rows.withColumn("text", F.lit(""))
        # a row key made of the rows, so a retried task rebuilds the same ids
        tr = tr.withColumn("__row", F.xxhash64(*keys)).withColumn("rating", F.col("rating").cast("double"))
        tr = tr.withColumn("full_description", X.full_description())
        spec = TextModelSpec(text_col="full_description", label_col="rating", doc_col="__row", max_features=RATING_TERMS, stop=True)
        found = {}

        def with_ids(d: DataFrame) -> DataFrame:  # the dictionaries come from the tokenised table, so the rows are joined once
            for c, i in (("user_id", "user_idx"), ("item_id", "item_idx")):
                found[c] = written(D.fit_index(d, c, i), c)
                d = D.apply_index(d, found[c], c, i, None, value_col=i).withColumn(i, F.col(i).cast("double"))
            return d

        with ExitStack() as pieces:
            for name, size in SMALL_PIECES.items():
                pieces.enter_context(setting(rows.sparkSession, name, size))
            stages, _, weighted = fit_text_features(tr, spec, ["rating", "user_id", "item_id"], with_ids)
            return RatingModel(_boosted(stages, weighted, "rating", trees), found["user_id"], found["item_id"])

    def score(self, rows: DataFrame) -> DataFrame:
        """F5 with this model; ``item_id`` stands for ``product_id`` where that is missing."""
        from feedpulse.operators.scoring import score_rating
        d = rows if "product_id" in rows.columns else rows.withColumnRenamed("item_id", "product_id")
        return score_rating(d, self.pipeline, self.users, self.items)

    def save(self, path: str) -> None:
        save_model(self.pipeline, f"{path}/pipeline")
        self.users.write.mode("overwrite").parquet(f"{path}/users")
        self.items.write.mode("overwrite").parquet(f"{path}/items")

    @staticmethod
    def load(spark, path: str) -> "RatingModel":
        return RatingModel(load_model(f"{path}/pipeline"), spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"))


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------- modified Huber

def train_modified_huber(weights_long: DataFrame, labels: DataFrame, doc: str = "doc_id", alpha: float = LINEAR_ALPHA,
                         eta: float = 0.5, max_epochs: int = 100, patience: int = 5, valid: DataFrame | None = None, on_epoch=None):
    """E5/E6 for weights in long form: ``weights_long`` (doc, idx, weight), ``labels`` and ``valid`` (doc, y in {0, 1}).

    The rows of a document are put together once; every epoch then is one pass over blocks
    (``linear.fit_modified_huber``). Returns (weights dict idx -> w, bias, history).
    """
    pairs = F.sort_array(F.collect_list(F.struct("idx", "weight")))  # a document's terms
    x = weights_long.groupBy(doc).agg(pairs.alias("x"))
    y = labels.select(doc, "y", F.lit(False).alias("valid"))
    y = y.unionByName(valid.select(doc, "y", F.lit(True).alias("valid"))) if valid is not None else y
    terms = (weights_long.agg(F.max("idx")).first()[0] or 0) + 1
    none = F.array().cast("array<struct<idx:int,weight:double>>")
    rows = y.join(x, doc, "left").withColumn("x", F.coalesce("x", none))
    blocks = L.to_blocks(rows, (F.col("x.idx"), F.col("x.weight")), F.col("y"), F.col("valid"))
    w, b, history = L.fit_modified_huber(blocks, terms, alpha, eta, max_epochs, patience, valid is not None,
                                         on_epoch and (lambda e, w, b, loss: on_epoch(e, _dict(w), b, loss)))
    return _dict(w), b, history


def _dict(w) -> dict[int, float]:
    return {i: float(x) for i, x in enumerate(w) if x}


def score_linear(weights_long: DataFrame, w: dict, b: float, doc: str = "doc_id") -> DataFrame:
    """Margin, class and probability of the linear model for weights in long form."""
    spark = weights_long.sparkSession
    wdf = spark.createDataFrame([(int(k), float(v)) for k, v in w.items()] or [(-1, 0.0)], "idx int, w double")
    f = (weights_long.join(F.broadcast(wdf), "idx", "left")
                     .groupBy(doc).agg((F.sum(F.col("weight") * F.coalesce(F.col("w"), F.lit(0.0))) + F.lit(b)).alias("margin")))
    return with_prediction(f)


def with_prediction(df: DataFrame) -> DataFrame:
    """Class and probability of a margin: p = (clip(f, -1, 1) + 1) / 2."""
    return df.withColumn("prediction", (F.col("margin") >= 0).cast("int")) \
             .withColumn("probability", (F.least(F.greatest(F.col("margin"), F.lit(-1.0)), F.lit(1.0)) + 1) / 2)


# ---------------------------------------------------------------- linear text model (E4/E5/E6 entry points)

@dataclass
class LinearTextModel:
    """A fitted modified-Huber text model: vocabulary (<= max_features rows), weights, bias."""
    spec: TextModelSpec
    vocab: DataFrame
    n_docs: int
    weights: dict
    bias: float

    def features(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` with their sparse vector ``features``."""
        tokens = Pipeline(stages=_token_stages(self.spec.text_col, "__tokens", self.spec.stop, self.spec.grams)).fit(df)
        stages = D.vectorizer_stages(self.vocab, "__tokens", "features", self.n_docs)
        return PipelineModel([*tokens.stages, *stages]).transform(df).select(*df.columns, "features")

    def terms(self) -> int:
        return max(self.weights, default=0) + 1

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` with margin, prediction (0/1) and probability; nothing is shuffled."""
        return self.apply(self.features(df)).drop("features")

    def apply(self, weighted: DataFrame) -> DataFrame:
        w = np.zeros((1, max(self.terms(), self.vocab_size())))
        for i, x in self.weights.items():
            w[0, i] = x
        return with_prediction(weighted.withColumn("margin", F.get(L.margins("features", w, np.array([self.bias])), F.lit(0))))

    def vocab_size(self) -> int:
        if not hasattr(self, "_size"):
            self._size = max(self.vocab.count(), 1)
        return self._size

    def save(self, path: str) -> None:
        """E14 for this model: vocabulary and weights as Parquet, scalars as a one-row table."""
        spark = self.vocab.sparkSession
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        spark.createDataFrame([(int(k), float(v)) for k, v in self.weights.items()] or [(-1, 0.0)],
                              "idx int, w double").write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(self.n_docs, self.bias, self.spec.text_col, self.spec.doc_col, self.spec.stop,
                                self.spec.grams)],
                              "n_docs long, bias double, text_col string, doc_col string, stop boolean, grams int") \
             .write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "LinearTextModel":
        m = spark.read.parquet(f"{path}/meta").first()
        w = {int(r["idx"]): r["w"] for r in spark.read.parquet(f"{path}/weights").collect() if r["idx"] >= 0}
        spec = TextModelSpec(text_col=m["text_col"], doc_col=m["doc_col"], stop=m["stop"], grams=m["grams"])
        return LinearTextModel(spec, spark.read.parquet(f"{path}/vocab"), m["n_docs"], w, m["bias"])


def _fit_huber(train: DataFrame, spec: TextModelSpec, max_epochs: int, valid_frac: float | None,
               on_epoch=None, seed: int = 42, base: LinearTextModel | None = None) -> LinearTextModel:
    """Fit the vocabulary (unless ``base`` has one) on the rows that are not held out, then the weights."""
    from feedpulse.operators.split import split_random
    d = train.select(spec.doc_col, spec.text_col, F.col(spec.label_col).cast("int").alias("y"))
    d = split_random(d, [spec.doc_col], valid_frac, seed, out="__valid") if valid_frac else d.withColumn("__valid", F.lit(False))
    if base is None:
        fit = d.where(~F.col("__valid"))
        toks = Pipeline(stages=_token_stages(spec.text_col, "__tokens", spec.stop, spec.grams)).fit(d).transform(fit.select(spec.doc_col, spec.text_col))
        base = LinearTextModel(spec, written(D.fit_vocab(toks, spec.doc_col, "__tokens", spec.min_df, spec.max_features), "vocab"), fit.count(), {}, 0.0)
    if not max_epochs:
        return base
    blocks = L.to_blocks(base.features(d), "features", F.col("y"), F.col("__valid"))
    w, b, _ = L.fit_modified_huber(blocks, base.vocab_size(), LINEAR_ALPHA, max_epochs=max_epochs, has_valid=bool(valid_frac), on_epoch=on_epoch)
    return LinearTextModel(spec, base.vocab, base.n_docs, _dict(w), b)


def train_linear(train: DataFrame, spec: TextModelSpec, loss: str = "log", max_iter: int = 100,
                 valid_frac: float | None = 0.1):
    """A linear text classifier; ``loss='log'`` (one-vs-rest logistic, a PipelineModel)
    or ``loss='modified_huber'`` (binary 0/1 labels, early stopping on a ``valid_frac`` hold-out)."""
    if loss == "log":
        return train_linear_log(train, spec, max_iter=max_iter)
    if loss == "modified_huber":
        return _fit_huber(train, spec, max_iter, valid_frac)
    raise ValueError(f"unknown loss {loss}")


def train_epochs(train: DataFrame, test: DataFrame, spec: TextModelSpec, epochs: int = 10):
    """``epochs`` full passes; after each, weighted F1 on ``test`` and the training loss.

    Returns the model and a metrics DataFrame ``(key, value, step)`` ready for ``log_run``.
    """
    from feedpulse.operators.evaluate import weighted_f1
    spark = train.sparkSession
    rows = []

    # the vocabulary is needed by the epoch callback; fit it first, then train with logging
    base = _fit_huber(train, spec, 0, None)
    # the test rows are tokenised and weighted once; each epoch only applies its weights
    feats = written(base.features(test.select(spec.doc_col, spec.text_col, F.col(spec.label_col).cast("int").alias("label"))), "epoch-test")

    def log(epoch, w, b, loss):
        scored = LinearTextModel(spec, base.vocab, base.n_docs, _dict(w), b)
        scored._size = base.vocab_size()
        f1 = weighted_f1(scored.apply(feats).select("prediction", "label"))
        rows.append(("weighted_f1", float(f1.first()["weighted_f1"] or 0.0), epoch))  # one number an epoch
        rows.append(("train_loss", float(loss), epoch))

    model = _fit_huber(train, spec, epochs, None, log, base=base)
    return model, spark.createDataFrame(rows, "key string, value double, step bigint")
