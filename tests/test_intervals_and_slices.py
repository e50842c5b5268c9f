"""Alerts as intervals, and counters by time slice, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from feedpulse.operators import alerts as A
from feedpulse.operators import timeseries as J
from feedpulse.operators.ordering import running_count, slice_of, time_splits

STEP = 60
RULES = [("Hot", {"severity": "warning"}, ">", 2.0, 120), ("Hot", {"severity": "critical"}, ">", 3.0, 100), ("Low", {"severity": "info"}, "<=", 0.0, 0)]


def expression(spark, seed=4, n=160):
    rng = random.Random(seed)
    rows = [(k, t * STEP, float(rng.choice([0, 1, 2, 3, 4, 4, 4]))) for k in ("a", "b", None) for t in range(n) if rng.random() > 0.05]
    rows += [("c", t * STEP, 4.0) for t in range(n)]  # one run from end to end
    return rows, spark.createDataFrame(rows, "component string, t long, v double")


def brute(rows):
    """(component, alertname, severity) -> runs as (start, fires_at or None, end, resolved_at or None)."""
    last, out = max(t for _, t, _ in rows), {}
    for name, lab, op, thr, hold in RULES:
        for k in {r[0] for r in rows}:
            good = sorted(t for c, t, v in rows if c == k and (v > thr if op == ">" else v <= thr))
            runs = []
            for t in good:
                if runs and runs[-1][1] == t - STEP:
                    runs[-1][1] = t
                else:
                    runs.append([t, t])
            for s, e in runs:
                fires = next((t for t in range(s, e + 1, STEP) if t - s >= hold), None)
                out.setdefault((k, name, lab["severity"]), []).append(
                    (s, fires, e, e + STEP if fires is not None and e + STEP <= last else None))
    return out


def test_runs_and_rows_agree(spark):
    rows, e = expression(spark)
    want = brute(rows)
    runs = A.alert_runs(e, ["component"], "v", RULES, STEP)
    got = {}
    for r in runs.collect():
        got.setdefault((r["component"], r["alertname"], r["severity"]), []).append((r["start"], r["fires_at"], r["end"], r["resolved_at"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    states = {(r["component"], r["alertname"], r["severity"], r["t"], r["state"]) for r in A.alerts_of_rules(e, ["component"], "v", RULES, STEP).collect()}
    expect = set()
    for k, v in want.items():
        for s, f, end, res in v:
            expect |= {(*k, t, "firing" if f is not None and t >= f else "pending") for t in range(s, end + 1, STEP)}
            expect |= {(*k, res, "resolved")} if res is not None else set()
    assert states == expect
    shown = {(r["component"], r["alertname"], r["severity"], r["t"], r["state"]) for r in A.run_instants(runs, STEP).collect()}
    assert shown == {x for x in expect if x[-1] != "pending"}
    one = A.alerts(e, ["component"], "v", ">", 2.0, 120, STEP, "Hot", {"severity": "warning"})
    assert one.columns == ["component", "t", "state", "active_since", "v", "alertname", "severity"]


@pytest.mark.parametrize("repeat", [60, 150, 600])
def test_grouping(spark, repeat):
    rows, e = expression(spark, 7)
    fire = {}
    for (k, name, sev), runs in brute(rows).items():
        for _, f, end, _ in runs:
            if f is not None:
                for t in range(f, end + 1, STEP):
                    fire.setdefault((name, sev), {}).setdefault(t, 0)
                    fire[name, sev][t] += 1
    want = set()
    for g, at in fire.items():
        start = None
        for t in sorted(at):
            if t - STEP not in at:
                start = t
            if (t - start) // repeat > (t - STEP - start) // repeat:
                want.add((*g, t, at[t]))
    by = ["alertname", "severity"]
    runs = A.group_runs(A.alert_runs(e, ["component"], "v", RULES, STEP), STEP, by, repeat)
    assert {tuple(r) for r in runs.select(*by, "notify_at", "alerts").collect()} == want
    again = A.group_alerts(A.alerts_of_rules(e, ["component"], "v", RULES, STEP), STEP, by, repeat)
    assert {tuple(r) for r in again.select(*by, "notify_at", "alerts").collect()} == want


def test_inhibition_by_intervals(spark, monkeypatch):
    monkeypatch.setattr(A, "INHIBIT_BUCKET", 400)
    rows, e = expression(spark, 9)
    table = A.alerts_of_rules(e, ["component"], "v", RULES, STEP)
    runs = A.alert_runs(e, ["component"], "v", RULES, STEP)
    want = brute(rows)
    silent = {(k[0] or "", k[1], t) for k, v in want.items() if k[2] == "critical" for _, f, end, _ in v if f is not None for t in range(f, end + 1, STEP)}
    key = lambda r: (r["component"], r["alertname"], r["severity"], r["t"], r["state"])
    expect = sorted((key(r) for r in table.collect() if not (r["severity"] == "warning" and (r["component"] or "", r["alertname"], r["t"]) in silent)), key=str)
    assert sorted((key(r) for r in A.inhibit(table, runs=runs).collect()), key=str) == expect
    assert sorted((key(r) for r in A.inhibit(table).collect()), key=str) == expect
    assert len(expect) < table.count()


def test_routes_stop_without_continue(spark):
    rows = [("critical", "drift", 1), ("warning", "drift", 2), ("info", None, 3), (None, "drift", 4)]
    df = spark.createDataFrame(rows, "severity string, alert_type string, t long")
    stop = [("severity", "critical", "pager", False), ("severity", "warning", "mail", True), ("alert_type", "drift", "drift", True)]
    got = A.route(df, stop, ["severity", "alert_type"], ["t"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "pager"), (2, "drift"), (2, "mail"), (3, "default"), (4, "drift")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert {tuple(r) for r in A.route(df, A.routes_frame(spark, stop), ["severity", "alert_type"], ["t"]).collect()} == {tuple(r) for r in got.collect()}


def samples(spark, seed=2):
    """One series with most rows, most of them in one step; resets; ties; a null series."""
    rng, rows = random.Random(seed), []
    for k, n in (("hot", 900), ("b", 60), (None, 40)):
        v = 0.0
        for u in sorted(rng.randrange(10_000_000) if k == "hot" and i % 4 else rng.randrange(4_000_000_000) for i in range(n)):
            v = 0.0 if rng.random() < 0.02 else v + rng.choice([0.0, 1.0, 2.5])
            rows.append((k, u, v))
    df = spark.createDataFrame(rows, "k string, us long, v double").select("k", F.timestamp_micros("us").alias("ts"), "us", "v")
    return rows, df


def test_deltas_in_one_shuffle_of_raw_rows(spark):
    rows, df = samples(spark)
    splits = time_splits(df, "ts", 40)
    assert len(splits) > 10 and splits == sorted(splits)
    got = {r["us"]: r["s"] for r in df.select("us", slice_of(F.col("ts"), splits).alias("s")).collect()}
    assert all(s == sum(x <= u for x in splits) for u, s in got.items())
    sizes = [r["count"] for r in df.groupBy(slice_of(F.col("ts"), splits)).count().collect()]
    assert max(sizes) < 4 * len(rows) / 40
    want = {}
    for k in ("hot", "b", None):
        prev = None
        for u, v in sorted((u, v) for s, u, v in rows if s == k):
            b = -(-u // 600_000_000) * 600
            d = 0.0 if prev is None else (v - prev if v >= prev else v)
            want[k, b] = want.get((k, b), 0.0) + d
            prev = v
    for cut in (None, splits):
        out = J.reset_deltas(df, ["k"], 600, value="v", splits=cut)
        assert {(r["k"], r["__b"]): pytest.approx(r["d"]) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Scan ") == 1 and "Checkpoint" not in plan
    assert sum(r["n"] for r in J.reset_deltas(df, ["k"], 600, value="v").collect()) == len(rows)


def test_running_count_by_slices(spark):
    rows, df = samples(spark, 5)
    out = running_count(df.withColumn("id", F.monotonically_increasing_id()), ["k"], ["ts", "id"], splits=time_splits(df, "ts", 16))
    for k in ("hot", "b", None):
        got = sorted((r["us"], r["value"]) for r in out.collect() if r["k"] == k)
        assert [v for _, v in got] == list(range(1, len(got) + 1))


def test_offset_delta_is_one_pass(spark):
    _, df = samples(spark, 6)
    a = J.rate(df.withColumn("value", F.col("v")), ["k"], 1200, 600).where("k is not null")
    b = J.rate(df.withColumn("value", F.col("v")), ["k"], 2400, 600).where("k is not null")
    want = {(r["k"], r["t"]): abs(r["rate"]) for r in a.select("k", "t", "rate").collect()}
    old = {(r["k"], r["t"] + 600): r["rate"] for r in b.collect()}
    expect = {x: abs(v - old[x]) for x, v in want.items() if x in old}
    d = J.offset_delta(df.withColumn("value", F.col("v")).where("k is not null"), ["k"], 1200, 2400, 600, 600)
    assert {(r["k"], r["t"]): pytest.approx(r["delta"]) for r in d.collect()} == expect
    assert d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Scan ") == 1
