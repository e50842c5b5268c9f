"""Property tests over generated inputs; each example is evaluated as one Spark batch."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedpulse.functions import text as X
from feedpulse.operators import features as D

SETTINGS = dict(max_examples=20, deadline=None, derandomize=True, database=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**SETTINGS)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_clean_trend_invariants(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(X.clean_trend("t").alias("c"))
    rows = [r["c"] for r in once.select("c", X.clean_trend("c").alias("cc")).collect()]
    twice = [r["cc"] for r in once.select("c", X.clean_trend("c").alias("cc")).collect()]
    assert rows == twice                                   # idempotent
    for c in rows:
        assert c == c.strip(" ") and "  " not in c         # squeezed and trimmed


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True)), min_size=1, max_size=30))
def test_clip_rating_range(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select(X.clip_rating("x").alias("y")).collect():
        assert 1.0 <= r["y"] <= 5.0 and not math.isnan(r["y"])


@settings(**SETTINGS)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "dd"]), max_size=8), min_size=1, max_size=10))
def test_ngram_counts(spark, docs):
    df = spark.createDataFrame([(d,) for d in docs], "t array<string>")
    got = [len(r[0]) for r in df.select(D.ngrams("t", 2)).collect()]
    assert got == [len(d) + max(len(d) - 1, 0) for d in docs]
