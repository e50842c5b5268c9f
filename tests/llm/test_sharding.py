"""Operator 8: the law, the slots, hot groups and odd rows."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from feedpulse.llm import sharding

from llm_helpers import ODD_TEXTS, docs, prose


def check(rows, got, n_shards=8):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < n_shards
        by[r["shard"]].append(r)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(n_shards):
        assert abs(sum(r["size"] for r in by[s]) - total / n_shards) <= most


def test_sizes_near_equal_with_a_hot_text_and_repeated_rows(spark):
    rng = random.Random(2)
    hot = prose(rng, 80)
    rows = list(enumerate([*ODD_TEXTS, *[prose(rng, rng.randrange(1, 200)) for _ in range(600)], *[hot] * 400]))
    rows += [(None, "null id"), (None, "null id")] + [(7, hot)] * 300
    check(rows, sharding.shard(docs(spark, rows), 8).collect())


def test_overfull_ranges_are_subdivided(spark):
    rows = [(i, "same") for i in range(3000)] + [(5000, "x" * 900)]
    check(rows, sharding.shard(docs(spark, rows), 8, rows_per_range=100, coarse_ranges=4).collect())


def test_boundaries_do_not_grow_in_the_plan(spark, monkeypatch):
    """Ten times the ranges: the plan holds the same boundaries, and joins without a broadcast give the same shards."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(1500)]
    a = sharding.shard(docs(spark, rows), 8, rows_per_range=500, coarse_ranges=3)
    b = sharding.shard(docs(spark, rows), 8, rows_per_range=20, coarse_ranges=3)
    check(rows, a.collect())
    check(rows, b.collect())
    monkeypatch.setattr(sharding, "SMALL_RANGES", 0)
    check(rows, sharding.shard(docs(spark, rows), 8, rows_per_range=20, coarse_ranges=3).collect())
    cuts = [F.array(*[F.lit(x).cast("bigint") for x in c]) for c in ([], [5], [1, 5, 9])]
    got = spark.range(12).select(*[sharding._inner(c, F.col("id"), 3) for c in cuts]).collect()
    assert [tuple(r) for r in got] == [(0, int(i >= 5), (i >= 1) + (i >= 5) + (i >= 9)) for i in range(12)]


def test_a_text_longer_than_a_mebibyte(spark):
    rows = [(1, "long " * 250_000), (2, "b"), (3, None)]
    check(rows, sharding.shard(docs(spark, rows), 2).collect(), 2)


def test_search_of_ranges(spark):
    cuts = sorted(random.Random(3).sample(range(-10**6, 10**6), 700))
    keys = [(k,) for k in [-2**62, 2**62, *cuts, *[c - 1 for c in cuts]]]
    got = spark.createDataFrame(keys, "key bigint").select("key", sharding._range_of(cuts, F.col("key")).alias("r")).collect()
    assert all(r["r"] == sum(c <= r["key"] for c in cuts) for r in got)


def test_empty_table_and_plan(spark):
    d = docs(spark, [(1, "a")])
    assert sharding.shard(d.limit(0)).count() == 0
    plan = sharding.shard(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
