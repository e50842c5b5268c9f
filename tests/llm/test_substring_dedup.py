"""Operator 9 against brute force."""

import hashlib
import json
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from feedpulse.llm import substring_dedup as S

from llm_helpers import ODD_TEXTS, docs, prose


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    n = Counter(tuple(w[k:k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = {j for k in range(len(w) - window + 1) if n[tuple(w[k:k + window])] > 1 for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def rows_of_all_kinds():
    rng = random.Random(12)
    passage, short = prose(rng, 80, 3000), prose(rng, 35, 3000)
    texts = [*ODD_TEXTS, *[prose(rng, rng.randrange(0, 60), 3000) + "\n" + passage + " " + prose(rng, rng.randrange(0, 60), 3000) for _ in range(40)],
             short, short, short.upper(), short + " x", short[:-1], "again and again " * 60, "z " * 34, "z " * 35, "z " * 36, prose(rng, 3000, 12),
             prose(rng, 100, 3000) + " " + passage[:200] + " y " + passage[150:], *[prose(rng, 200, 3000) for _ in range(5)]]
    return list(enumerate(texts)) + [(None, short), (60, passage), (60, passage), (61, "alone " + prose(rng, 50, 3000))]


def test_equals_brute_force(spark):
    rows = rows_of_all_kinds()
    got = S.digest(docs(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute(rows, 35)


def test_lengthened_prefixes_equal_brute_force(spark, monkeypatch):
    """Every prefix that more than two suffixes share is too large for a group."""
    for rows_in_group, small in ((2, 0), (5, 20_000), (10_000, 0)):
        monkeypatch.setattr(S, "GROUP_ROWS", rows_in_group)
        monkeypatch.setattr(S, "SORT_ROWS", 3)
        monkeypatch.setattr(S, "SMALL_NODES", small)
        rows = rows_of_all_kinds()
        assert Counter(map(tuple, S.digest(docs(spark, rows)).collect())) == brute(rows, 35)


def test_very_long_texts(spark):
    """Texts of more than the 1 MiB at which a text is worked on by itself."""
    rng = random.Random(21)
    long, passage = prose(rng, 170_000, 50_000), prose(rng, 60, 50_000)
    rows = [(1, long), (2, passage + " " + long[-400_000:]), (3, prose(rng, 40, 50_000) + " " + passage)]
    assert len(long) > 1 << 20
    assert Counter(map(tuple, S.digest(docs(spark, rows)).collect())) == brute(rows, 35)


def test_subtrees():
    """Suffixes sorted by their words: marks equal a count of the windows; words whose numbers end in zeros, and none."""
    rng = random.Random(3)
    slices = [" ".join(rng.choice(["a", "b", "é"]) for _ in range(rng.randrange(0, 20))).encode() for _ in range(300)]
    own, first, shared = S.sort_suffixes(slices, 6)
    words = [x.split() for x in slices]
    n = Counter(tuple(w[i:i + 6]) for w in words for i in range(len(w) - 5))
    assert [(o, f) for o, f in zip(own, first)] == [(o, f) for o, w in enumerate(words) for f in range(len(w) - 5)]
    assert shared.tolist() == [n[tuple(words[o][f:f + 6])] > 1 for o, f in zip(own, first)]
    assert [len(x) for x in S.sort_suffixes([], 6)] == [0, 0, 0] == [len(x) for x in S.sort_suffixes([b"", b"a b"], 6)]
    got = {(o, x) for o, f, c in zip(*S.repeats_of(slices * 2, 6)) for x in range(f, f + c)}
    assert got == {(o, f) for o, w in enumerate(words * 2) for f in range(len(w) - 5)}  # every slice is there twice
    got = {(o, x) for o, f, c in zip(*S.repeats_of(slices, 6)) for x in range(f, f + c)}
    assert got == {(o, f) for o, w in enumerate(words) for f in range(len(w) - 5) if n[tuple(w[f:f + 6])] > 1}
    runs = S._runs(np.array([0, 0, 0, 1, 1]), np.array([2, 3, 7, 8, 9]))
    assert [x.tolist() for x in runs] == [[0, 0, 1], [2, 7, 8], [2, 1, 2]]


def test_other_windows_and_repeated_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "x a b c y"), (3, "b c")]
    got = S.dedup(docs(spark, rows), window=3, prefix=2).collect()
    want = brute(rows, 3)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == want


def test_documents_keep_their_columns(spark):
    rows = rows_of_all_kinds()
    d = docs(spark, rows)
    out = S.dedup_documents(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    plain = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in d.collect()}
    digests = {(k[0], k[3]) for k, _ in brute(rows, 35).items()}
    for r in out.collect():
        own = (r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert own in plain or own in digests
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    assert S.digest(d.limit(0)).count() == 0 and S.dedup_documents(d.limit(0)).count() == 0


def test_least_places():
    rng = np.random.default_rng(13)
    g = rng.integers(0, 6, 60).astype(np.uint64)
    for width in (1, 2, 3, 7, 28):
        assert S.least_places(g, width).tolist() == [i + int(np.argmin(g[i:i + width])) for i in range(60 - width + 1)]


def test_split_by(spark, monkeypatch):
    """No key is lost, each row is in one part, few others are among the keys; a bitmap too small for its keys only lets more through."""
    keys = spark.range(0, 30_000, 10).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("t"))
    rows = spark.range(30_000).select(F.when(F.col("id") > 0, F.col("id")).alias("bit"), F.lit("x").alias("bits"), F.col("id").alias("a.b"))
    for most in (S.FILTER_MOST, 8):
        monkeypatch.setattr(S, "FILTER_MOST", most)
        some, rest = S.split_by(rows, ["bit", "bits"], keys, ["k", "t"], 3_000)
        assert some.columns == rest.columns == rows.columns
        a, b = ([r["a.b"] for r in x.collect()] for x in (some, rest))
        assert sorted(a + b) == list(range(30_000)) and not any(i % 10 == 0 for i in b)
        assert len(a) < 3_500 or most == 8
    assert len(a) == 30_000
    assert S.split_by(rows, ["bit"], keys.limit(0), ["k"], 0)[1].count() == 30_000


def test_full_bitmaps_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "FILTER_MOST", 8)
    rows = rows_of_all_kinds()
    assert Counter(map(tuple, S.digest(docs(spark, rows)).collect())) == brute(rows, 35)


SHUFFLES = """
import json, random, sys
root, at, form = sys.argv[1:]
sys.path[:0] = [root, root + "/tests/llm"]
from pyspark.sql import SparkSession
from llm_helpers import prose
from feedpulse.llm import substring_dedup as S
spark = SparkSession.builder.config(map={
    "spark.master": "local[2]", "spark.driver.memory": "2g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.checkpoint.dir": f"file://{at}/shared", "spark.eventLog.enabled": "true",
    "spark.eventLog.dir": f"file://{at}/events", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}).getOrCreate()
rng = random.Random(5)
passage = prose(rng, 60, 10 ** 6)
rows = [(i, prose(rng, 300, 10 ** 6) + " " + (passage if i % 100 == 0 else "")) for i in range(3000)]
spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(at + "/docs")
getattr(S, form)(spark.read.parquet(at + "/docs")).write.parquet(at + "/out")
print("BYTES", sum(len(t) for _, t in rows))
spark.stop()
"""


def test_texts_that_repeat_nothing_are_not_shuffled(tmp_path):
    """One document in a hundred repeats something: what is shuffled, by Spark's event log, is far less than the texts."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for form in ("digest", "dedup_documents"):
        at = tmp_path / form
        (at / "events").mkdir(parents=True)
        done = subprocess.run([sys.executable, "-c", SHUFFLES, root, str(at), form], capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        size = int(done.stdout.split("BYTES")[1])
        log = [json.loads(x) for p in (at / "events").iterdir() if p.is_file() for x in p.read_text().splitlines()]
        sent = sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in log
                   if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"))
        assert 0 < sent < 0.5 * size, (form, sent, size)
