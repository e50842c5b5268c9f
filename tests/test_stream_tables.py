"""Streams over tables that are folders of files, and sliding rates up to the last event."""

import datetime as dt

from feedpulse.plans import q_stream
from feedpulse.streaming import streams as K


def _events(spark, path, files):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, 7 * (i % 8)) + dt.timedelta(minutes=i), i % 3, ("click", "view")[i % 2], float(i), "{}") for i in range(40)]
    spark.createDataFrame(rows, K.EVENT_SCHEMA).repartition(files).write.parquet(f"{path}/events.parquet")


def test_table_in_several_files_is_streamed(spark, tmp_path):
    docs = [(i, "pin ship"[4 * (i % 2):], "en", "s", 4) for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
         .repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    _events(spark, tmp_path, 3)
    got = q_stream.q_stream_score(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == 60 and {r["topic"] for r in got} == {"Battery", "Shipping"}
    assert q_stream.q_stream_ingest(spark, str(tmp_path)).count() == 40
    assert sum(r["total_volume"] for r in q_stream.q_stream_trend_gold(spark, str(tmp_path)).collect()) == 40


def test_rates_hold_every_window(spark, tmp_path):
    _events(spark, tmp_path, 3)
    want = {}
    for e in spark.read.parquet(f"{tmp_path}/events.parquet").collect():
        at = int(e["ts"].replace(tzinfo=dt.timezone.utc).timestamp()) // 15 * 15
        for j in range(20):
            want[at - 15 * j, e["event_type"]] = want.get((at - 15 * j, e["event_type"]), 0) + 1
    got = q_stream.q_stream_rates(spark, str(tmp_path)).collect()
    assert {(r["window_start"], r["event_type"]): r["n"] for r in got} == want and len(got) == len(want)
