"""Operator 7 against exact integer scores."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from feedpulse.llm import topk


def brute(rows, k=10):
    v = [(i, x) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    ints = [[math.floor(Fraction(c) * 1024) for c in x] for _, x in v]
    out = []
    for q, (i, _) in enumerate(v):
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), v[c][0]) for c in range(len(v)) if c != q)[:k]
            out += [(i, r + 1, c, min(max(-x, -2**63), 2**63 - 1)) for r, (x, c) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("block", F.lit(1)).withColumn("uid", F.lit("x"))
    return sorted(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0, 10, **kw).select("query_id", "rank", "vec_id", "score").collect()))


def test_ties_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 128)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * 0.2).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25] * 12) for i in range(200)]                        # one common vector
    rows += [(2000, None), (2100, [None] * 12), (2200, [float("nan")] * 12), (2300, [float("inf")] * 12), (None, [0.1] * 12),
             (2400, [1e9] * 12), (2500, []), (2600, [0.5, 0.5]), (2700, [-60000.0] * 12), (100, [0.1] * 12)]
    assert run(spark, rows) == brute(rows)


def test_wide_components(spark, monkeypatch):
    """Components of 65 536 and more, up to the largest doubles, among small ones."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * 0.3).tolist()) for i in range(300)]
    rows += [(1000 + 20 * i, (rng.normal(size=5) * 10.0 ** rng.integers(3, 12)).tolist()) for i in range(60)]
    rows += [(3000, [1e9] * 5), (3001, [1e9] * 5), (3002, [-1e9] * 5), (3100, [65536.0, 0.5, -65535.9, 1.0, 2.0]), (3200, [1e308, -1e308, 1.0, 0.0, 3.0]),
             (3300, [-1.7e308] * 5), (3400, [70000.0, 1.0]), (3500, [2.0**53 + 2, 1e-3, 0.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [70000.0, 1.0]), (1, [1.0, 2.0]), (100, [3.0, 4.0])]) == brute([(0, [70000.0, 1.0]), (1, [1.0, 2.0]), (100, [3.0, 4.0])])


def test_fewer_rows_than_asked_for_and_none(spark):
    rows = [(0, [0.5, -0.5]), (1, [0.1, 0.2]), (2, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").limit(0)
    assert topk.search(df, F.col("vec_id") % 100 == 0).count() == 0


def test_digits_and_sums():
    for w in range(-600, 600):
        d = topk.digits(w)
        assert sum(s << p for p, s in d) == w and all(b[0] - a[0] > 1 for a, b in zip(d, d[1:]))
