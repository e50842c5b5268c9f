"""Linear classifiers trained on blocks of sparse rows.

Rows with a sparse vector in them become compressed blocks once (one Arrow batch each, written to the
shared folder). An iteration broadcasts the weights of all classes, every partition adds up the
gradient of its blocks as one array, and the arrays are added up in two steps; no (document, term)
row moves, and the number of jobs does not depend on the number of classes. Weights and gradients
hold at most classes x max_features numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.operators.features import sparse_parts
from feedpulse.session import setting, written

SUM_TASKS = 16  # arrays that reach the driver
DIRECT_BYTES = 1 << 26  # arrays of all tasks that may reach the driver at once, without that step
BLOCK_ROWS = 2048  # rows of a block
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CACHE_ROWS = "spark.sql.inMemoryColumnarStorage.batchSize"


def to_blocks(rows: DataFrame, features: str | tuple[Column, Column], label: Column, valid: Column | None = None, name: str = "blocks") -> DataFrame:
    """Blocks (n, ends, idx, val, y, valid) of the rows' sparse vectors (a vector column, or arrays of indices and
    values); ``label`` is a class number, and rows without one are left out. ``valid`` marks the rows that are only judged."""
    idx, val = sparse_parts(features) if isinstance(features, str) else features
    flat = rows.select(idx.alias("idx"), val.alias("val"), label.cast("int").alias("y"),
                       (F.lit(False) if valid is None else valid).alias("valid")).where(F.col("y").isNotNull())

    most = BLOCK_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                b = whole.slice(at, most)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                numbers = (b.column(0).flatten(), np.int32), (b.column(1).flatten(), np.float64), (b.column(2), np.int32), (b.column(3), bool)
                cells = [ends, *[x.to_numpy(zero_copy_only=False).astype(t) for x, t in numbers]]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in cells]],
                                                 ["n", "ends", "idx", "val", "y", "valid"])

    with setting(flat.sparkSession, ARROW_ROWS, str(most)):
        return written(flat.mapInArrow(pack, "n int, ends binary, idx binary, val binary, y binary, valid binary"), name)


class Sums:
    """What one pass over the blocks gives, by class: gradient, gradient of the bias, losses."""

    def __init__(self, flat: np.ndarray, classes: int, terms: int):
        at = classes * terms
        self.grad = flat[:at].reshape(classes, terms)
        self.bias_grad, self.loss, self.valid_loss = flat[at:].reshape(-1)[:3 * classes].reshape(3, classes)
        self.n, self.valid_n = flat[-2:]


def _kernels():
    """(dense_rows, margin_of) as values that go to the executors with the code that uses them."""

    def dense_rows(ends, idx, val, terms):
        """The sparse rows as dense matrices of 2 MB each: (first row, row after the last, matrix)."""
        import numpy as np
        sizes = np.diff(ends, prepend=0)
        most = max((1 << 18) // max(terms, 1), 1)
        x = np.zeros((min(most, max(len(ends), 1)), terms))
        for a in range(0, len(ends), most):
            z = min(a + most, len(ends))
            lo, hi = ends[a] - sizes[a], ends[z - 1]
            at = np.repeat(np.arange(z - a), sizes[a:z]), idx[lo:hi]  # a row's indices are distinct
            x[at] = val[lo:hi]
            yield a, z, x[:z - a]
            x[at] = 0.0

    def margin_of(ends, idx, val, w, b):
        """Rows x classes; many classes are multiplied at once, a few by their sparse sums."""
        import numpy as np
        n, (classes, terms) = len(ends), w.shape
        f = np.empty((n, classes))
        if classes >= 4 and terms <= 20_000:
            for a, z, x in dense_rows(ends, idx, val, terms):
                f[a:z] = x @ w.T
        else:
            own = np.repeat(np.arange(n), np.diff(ends, prepend=0))
            for k in range(classes):
                f[:, k] = np.bincount(own, weights=val * w[k][idx], minlength=n)
        return f + b

    return dense_rows, margin_of


def evaluate(blocks: DataFrame, w: np.ndarray, b: np.ndarray, loss: str, tasks: int | None = None) -> Sums:
    """One pass: sums over all rows of the loss (``log`` or ``modified_huber``) and its gradient, for each class
    against the others. With a single class, y is 0 or 1. A known number of ``tasks`` saves the step between if it is small."""
    classes, terms = w.shape
    spark = blocks.sparkSession
    weights = spark.sparkContext.broadcast((w, b))
    dense_rows, margin_of = _kernels()

    def one(ends, idx, val, y, valid, w, b):
        import numpy as np
        grad = np.zeros((classes, terms))
        sign = np.where(y[:, None] == (np.array([1]) if classes == 1 else np.arange(classes)), 1.0, -1.0)
        z = sign * margin_of(ends, idx, val, w, b)
        if loss == "log":
            cost, slope = np.logaddexp(0.0, -z), -sign / (1.0 + np.exp(np.minimum(z, 700.0)))
        else:
            cost = np.where(z >= 1, 0.0, np.where(z >= -1, (1 - z) * (1 - z), -4 * z))
            slope = sign * np.where(z >= 1, 0.0, np.where(z >= -1, -2 * (1 - z), -4.0))
        slope = np.where(valid[:, None], 0.0, slope)
        if classes >= 4 and terms <= 20_000:
            for a, e, x in dense_rows(ends, idx, val, terms):
                grad += slope[a:e].T @ x
        else:
            own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            for k in range(classes):
                grad[k] = np.bincount(idx, weights=val * slope[own, k], minlength=terms)
        rest = np.array([slope.sum(axis=0), cost[~valid].sum(axis=0), cost[valid].sum(axis=0)])
        return np.concatenate([grad.ravel(), rest.ravel(), [float((~valid).sum()), float(valid.sum())]])

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        total, part = None, 0
        for f in batches:
            part = f.column(5)[0].as_py()
            for i in range(f.num_rows):
                types = np.int64, np.int32, np.float64, np.int32, bool
                got = one(*[np.frombuffer(f.column(j)[i].as_buffer(), t) for j, t in enumerate(types)], *weights.value)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    own = blocks.select("ends", "idx", "val", "y", "valid", F.spark_partition_id().alias("part"))
    parts = own.mapInArrow(partition, "part int, sums binary")
    with setting(spark, ARROW_ROWS, "1"):  # a row is a block: a worker holds one of them, whatever its partition's size
        total = add_up(parts, tasks is not None and tasks * 8 * classes * (terms + 3) <= DIRECT_BYTES)
    weights.unpersist()
    return Sums(np.zeros(classes * (terms + 3) + 2) if total is None else total, classes, terms)


def add_up(parts: DataFrame, direct: bool = False) -> np.ndarray | None:
    """The sum of the arrays ``sums`` of (part, sums) in one order, whatever arrives first; None without any. In two
    steps, unless all arrays may reach the driver (``direct``)."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd
        total = sum(np.frombuffer(x, np.float64) for x in f.sort_values("part")["sums"])
        return pd.DataFrame({"part": [int(f["part"].iloc[0]) % SUM_TASKS], "sums": [total.tobytes()]})

    if not direct:
        parts = parts.groupBy(F.pmod("part", F.lit(SUM_TASKS))).applyInPandas(add, "part int, sums binary")
    got = sorted(parts.collect(), key=lambda r: r["part"])
    return sum(np.frombuffer(r["sums"], np.float64) for r in got) if got else None


def fit_modified_huber(blocks: DataFrame, terms: int, alpha: float, eta: float = 0.5, max_epochs: int = 100, patience: int = 5,
                       has_valid: bool = False, on_epoch: Callable | None = None) -> tuple[np.ndarray, float, list]:
    """Full-batch gradient descent under the modified Huber loss with L2 ``alpha``; one job an epoch.

    With ``has_valid`` it stops after ``patience`` epochs without a better loss on the valid rows and
    keeps the best epoch's weights. Returns (weights, bias, [(epoch, loss at its start)]).
    """
    w, b, history = np.zeros((1, terms)), np.zeros(1), []
    best, best_state, since = np.inf, (w, b), 0
    for epoch in range(1, max_epochs + 2):
        last = epoch > max_epochs  # only to judge the last epoch's weights
        if last and not (has_valid and max_epochs):
            break
        s = evaluate(blocks, w, b, "modified_huber")
        if has_valid and s.valid_n and epoch > 1:
            judged = s.valid_loss[0] / s.valid_n
            if judged < best - 1e-9:
                best, best_state, since = judged, (w, b), 0
            elif (since := since + 1) >= patience:
                break
        if last:
            break
        n = max(s.n, 1.0)
        w, b = w - eta * (s.grad / n + alpha * w), b - eta * s.bias_grad / n
        history.append((epoch, float(s.loss[0] / n)))
        if on_epoch:
            on_epoch(epoch, w[0], float(b[0]), history[-1][1])
    if best < np.inf:
        w, b = best_state
    return w[0], float(b[0]), history


def fit_one_vs_rest(blocks: DataFrame, classes: int, terms: int, reg: float, max_iter: int = 100, tol: float = 1e-6,
                    memory: int = 10) -> tuple[np.ndarray, np.ndarray, int]:
    """All classes' log-loss models together: L-BFGS with a memory and a step of its own for each class, one
    pass over the blocks for a trial of all of them. The bias is not regularised. Returns (weights, biases, passes).

    The blocks are cached for the passes, on disk where memory does not hold them."""
    with setting(blocks.sparkSession, CACHE_ROWS, "1"):  # a row is a block
        blocks = blocks.persist()
    try:
        return _lbfgs(blocks, classes, terms, reg, max_iter, tol, memory)
    finally:
        blocks.unpersist()


def _lbfgs(blocks: DataFrame, classes: int, terms: int, reg: float, max_iter: int, tol: float, memory: int) -> tuple[np.ndarray, np.ndarray, int]:
    x, passes, tasks = np.zeros((classes, terms + 1)), 0, blocks.rdd.getNumPartitions()

    def value(x):
        nonlocal passes
        passes += 1
        s = evaluate(blocks, np.ascontiguousarray(x[:, :terms]), x[:, terms].copy(), "log", tasks)
        n = max(s.n, 1.0)
        g = np.concatenate([s.grad / n + reg * x[:, :terms], s.bias_grad[:, None] / n], axis=1)
        return s.loss / n + reg / 2 * (x[:, :terms] ** 2).sum(axis=1), g

    f, g = value(x)
    live, steps = np.ones(classes, bool), []
    for _ in range(max_iter):
        q, used = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s * q).sum(axis=1)
            q -= a[:, None] * y
            used.append(a)
        if steps:
            s, y, rho = steps[-1]
            q *= np.where(rho > 0, (s * y).sum(axis=1) / np.maximum((y * y).sum(axis=1), 1e-300), 1.0)[:, None]
        for (s, y, rho), a in zip(steps, reversed(used)):
            q += (a - rho * (y * q).sum(axis=1))[:, None] * s
        slope = -(g * q).sum(axis=1)
        down = slope < 0
        q, slope = np.where(down[:, None], q, g), np.where(down, slope, -(g * g).sum(axis=1))
        step = np.where(live, 1.0 if steps else 1.0 / np.maximum(np.sqrt((g * g).sum(axis=1)), 1e-12), 0.0)
        for _ in range(30):
            f1, g1 = value(x - step[:, None] * q)
            short = live & (f1 > f + 1e-4 * step * slope)
            if not short.any():
                break
            step = np.where(short, step / 2, step)
        else:
            step = np.where(short, 0.0, step)  # no descent is left for these
            f1, g1 = value(x - step[:, None] * q)
        x1 = x - step[:, None] * q
        s, y = x1 - x, g1 - g
        sy = (s * y).sum(axis=1)
        steps = [*steps, (s, y, np.where(sy > 1e-12, 1.0 / np.where(sy > 1e-12, sy, 1.0), 0.0))][-memory:]
        live = live & (f - f1 > tol * np.maximum(np.abs(f), 1e-12)) & (np.abs(g1).max(axis=1) > tol)
        x, f, g = x1, f1, g1
        if not live.any():
            break
    return x[:, :terms], x[:, terms], passes


def margins(features: str | Column, w: np.ndarray, b: np.ndarray) -> Column:
    """Array of the classes' margins of a sparse vector, in the row: one matrix product for a batch of rows."""
    idx, val = sparse_parts(features)
    _, margin_of = _kernels()
    w, b = np.ascontiguousarray(w, np.float64), np.asarray(b, np.float64)

    @F.arrow_udf("array<double>")
    def score(i: pa.Array, v: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        sizes = pc.fill_null(pc.list_value_length(i), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        f = margin_of(np.cumsum(sizes), i.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False), w, b)
        ends = pa.array(np.arange(len(i) + 1, dtype=np.int32) * np.int32(f.shape[1]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(f.ravel(), pa.float64()), mask=i.is_null() if i.null_count else None)

    return score(idx, val)


class LinearHead(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted one-vs-rest linear model as a pipeline stage: margins, probabilities (the classes' sigmoids
    normalised to sum 1) and the label of the largest margin. Plain column expressions, so it works on streams too."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", prefix: str = "", labels: list | None = None,
                 weights: list | None = None, bias: list | None = None):
        super().__init__()
        for name, doc in (("featuresCol", "vector column"), ("prefix", "of the output columns"), ("labels", "class labels"),
                          ("weights", "a list of numbers for each class"), ("bias", "a number for each class")):
            setattr(self, name, Param(self, name, doc))
        self._setDefault(featuresCol="features", prefix="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = lambda name: self.getOrDefault(getattr(self, name))
        p, labels = get("prefix"), get("labels")
        m = f"{p}margins"
        d = dataset.withColumn(m, margins(get("featuresCol"), np.array(get("weights")).reshape(len(labels), -1), np.array(get("bias"))))
        sigmoid = F.transform(m, lambda x: 1 / (1 + F.exp(-x)))
        total = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        shares = F.element_at(F.transform(F.array(sigmoid), lambda s: F.transform(s, lambda x: x / total(s))), 1)
        best = F.array_position(m, F.array_max(m)).cast("int")
        return d.withColumn(f"{p}probability_arr", shares).withColumn(f"{p}predicted_label", F.get(F.array(*[F.lit(x) for x in labels]), best - 1))


def head_of(w: np.ndarray, b: np.ndarray, labels: list, features: str = "features", prefix: str = "") -> LinearHead:
    return LinearHead(featuresCol=features, prefix=prefix, labels=list(labels), weights=[[float(x) for x in row] for row in w],
                      bias=[float(x) for x in b])
