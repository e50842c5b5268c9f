"""State of the streaming operators: panes instead of events, and nothing left of a silent series."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from feedpulse.operators import alerts as A
from feedpulse.session import scratch_path
from feedpulse.streaming import streams as K

T0 = dt.datetime(2024, 1, 1)
BASE = 1_704_067_200


def _dirs(spark):
    b = scratch_path(spark, f"tests/{uuid.uuid4().hex}")
    return f"{b}/in", f"{b}/out", f"{b}/ckpt"


def state_rows(spark, checkpoint, operator):
    d = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return d.count()


def test_rates_by_panes(spark):
    src, out, ck = _dirs(spark)
    rows = [(T0 + dt.timedelta(seconds=s), k) for s in range(0, 1200, 5) for k in ("a", "b") for _ in range(20)]
    schema = "ts timestamp, k string"
    spark.createDataFrame(rows[:6000], schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: K.stream_rates(spark.readStream.schema(schema).parquet(src), ["k"], late_delay="1 minute")
    K.run_available(stream(), out, ck)
    # the later rows arrive after a restart
    spark.createDataFrame(rows[6000:], schema).coalesce(1).write.mode("append").parquet(src)
    got = {(r["window_start"] - BASE, r["k"]): (r["n"], r["rate"]) for r in K.run_available(stream(), out, ck).collect()}
    closed = 1195 - 60
    want = {}
    for t, k in rows:
        s = int((t - T0).total_seconds()) // 15 * 15
        for w in range(s - 285, s + 15, 15):
            if w + 300 <= closed:
                want[w, k] = want.get((w, k), 0) + 1
    assert got == {x: (n, n / 300.0) for x, n in want.items()}
    # open panes, and the windows that hold them: a state row per key and each, however many events there were
    panes, windows = sorted(state_rows(spark, ck, i) for i in (0, 1))
    assert 0 < panes <= 2 * (60 // 15 + 2) and windows <= 2 * (300 // 15 + 60 // 15 + 3)


def test_silent_series_leaves_no_state(spark):
    src, out, ck = _dirs(spark)
    step, schema = 60, "k string, t long, value double"
    vals = {"s": [(0, 5.0), (60, 5.0), (120, 5.0), (180, 5.0)], "quiet": [(60, 1.0)], "clock": []}
    arrivals = [[("s", 120), ("s", 0), ("quiet", 60)], [("s", 60), ("s", 180)], [("clock", 4000)], [("clock", 9000)]]
    of = {(k, t): v for k, x in vals.items() for t, v in x}
    got = None
    for part in arrivals:  # every arrival after a restart of the query
        spark.createDataFrame([(k, BASE + t, of.get((k, t))) for k, t in part], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        got = K.run_available(K.stream_alerts(stream, "k", 2.0, 120, step, late_delay="10 minutes"), out, ck)
    e = spark.createDataFrame([("s", BASE + t, v) for t, v in vals["s"]], "k string, t long, value double")
    want = {tuple(r) for r in A.alerts(e, ["k"], "value", ">", 2.0, 120, step, "X", horizon=BASE + 9000).select("k", "t", "state", "active_since").collect()}
    assert {tuple(r) for r in got.collect()} == want and any(r[2] == "resolved" for r in want)
    for name in ("run", "waiting"):
        left = spark.read.format("statestore").option("stateVarName", name).load(ck)
        assert left.where(F.col("key.series").isin("s", "quiet")).count() == 0
    assert spark.conf.get(K.STATE_STORE, "") != K.ROCKSDB  # the session's setting is as it was
