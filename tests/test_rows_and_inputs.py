"""No row is lost: null keys and labels, mixed CSV headers, written dates, text where numbers are due; start-up."""

import datetime as dt
import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from feedpulse.functions import schema as S
from feedpulse.functions import text as X
from feedpulse.operators import kpi as K
from feedpulse.operators import metrics as M
from feedpulse.operators.ordering import running_count
from feedpulse.operators.split import split_stratified
from feedpulse.operators.train import train_modified_huber
from feedpulse.sources import io as IO

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stratified_split_keeps_null_labels(spark):
    rows = [(i, ["a", "b", None, "c"][i % 4]) for i in range(40)]
    got = split_stratified(spark.createDataFrame(rows, "k long, lab string"), ["k"], "lab", 0.2).collect()
    assert len(got) == 40
    assert all(sum(r["is_test"] for r in got if r["lab"] == x) == 2 for x in ("a", "b", None, "c"))


def test_running_count_keeps_null_keys_and_buckets(spark):
    rows = [(["a", None][i % 2], i if i % 5 else None, i) for i in range(20)]
    d = spark.createDataFrame(rows, "k string, ts long, id long")
    got = running_count(d, ["k"], ["ts", "id"]).collect()
    assert len(got) == 20
    for k in ("a", None):
        assert sorted(r["value"] for r in got if r["k"] == k) == list(range(1, 11))


def test_volatility_skips_rows_without_a_user(spark):
    d = spark.createDataFrame([("u", 1.0), ("u", 3.0), (None, 1.0), (None, 5.0)], "user_id string, predicted_rating double")
    assert K.user_volatility(d).first()[0] == pytest.approx(2 ** 0.5)


def test_mixed_headers_encodings_and_spaces_in_paths(spark, tmp_path):
    folder = tmp_path / "a folder+x"
    folder.mkdir()
    (folder / "one file.csv").write_bytes("comment,date\nhällo,2024-01-01\n".encode("utf-8"))
    (folder / "two.csv").write_bytes("date,comment\n2024-01-02,wörld\n".encode("utf-8"))
    (folder / "three.csv").write_bytes("date,comment\n2024-01-03,caf\xe9\n".encode("latin-1"))
    want = {("hällo", "2024-01-01"), ("wörld", "2024-01-02"), ("café", "2024-01-03")}
    for schema in (None, spark.createDataFrame([], "comment string, date string").schema):
        got = IO.read_csv_any_encoding(spark, str(folder), schema).select("comment", "date").collect()
        assert {tuple(r) for r in got} == want


def test_rejected_files_are_listed_and_storage_errors_raised(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe\xff,\xff\n1,2\n")
    bad = IO.rejected_files(spark, str(tmp_path)).collect()
    assert [os.path.basename(r["path"]) for r in bad] == ["bad.csv"] and "UTF-8" in bad[0]["reason"]
    assert IO.read_csv_folder(spark, str(tmp_path), skip_bad=True).count() == 1
    with pytest.raises(ValueError):
        IO.read_csv_folder(spark, str(tmp_path))
    with pytest.raises(Exception):
        IO.first_line(spark, str(tmp_path / "missing.csv"))


def test_bad_lines_below_the_header_and_split_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n" + "1,2\n" * 50_000)
    (tmp_path / "below äö.csv").write_bytes(b"a,b\n1,2\n\xff,3\n4,\xfe\n")
    bad = IO.rejected_files(spark, str(tmp_path)).collect()
    assert [(os.path.basename(r["path"]), r["bad_lines"]) for r in bad] == [("below äö.csv", 2)] and "below the header" in bad[0]["reason"]
    kept = IO.read_csv_folder(spark, str(tmp_path), skip_bad=True)
    assert kept.count() == 50_000
    assert IO.bad_lines(spark, str(tmp_path), encoding="ISO-8859-1").count() == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:  # a large file is several tasks, unless line breaks in quotes are asked for
        assert IO.read_csv_folder(spark, str(tmp_path), skip_bad=True).rdd.getNumPartitions() > 3
        assert IO.read_csv_folder(spark, str(tmp_path), skip_bad=True, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text, want", [
    ("2024-01-15T10:00:00Z", dt.datetime(2024, 1, 15, 10)), ("2024/01/15", dt.datetime(2024, 1, 15)), ("01/15/2024", dt.datetime(2024, 1, 15)),
    ("Jan 15, 2024", dt.datetime(2024, 1, 15)), ("20240115", dt.datetime(2024, 1, 15)), ("15 January 2024", dt.datetime(2024, 1, 15)),
    ("2024-01-15", dt.datetime(2024, 1, 15)), ("soon", None), (None, None)])
def test_written_dates(spark, text, want):
    d = spark.createDataFrame([(text,)], "d string")
    assert d.select(S.to_ts("d")).first()[0] == want
    assert S.dropped_dates(d, "d").first()["n_unread_dates"] == int(text == "soon")


def test_text_where_numbers_are_due(spark):
    d = spark.createDataFrame([("abc", "x", "", "no", "maybe", True), ("0.7", "9", "2.5", "3", "1", False)],
                              "confidence string, rating string, processing_time string, batch_size string, is_cold_start string, success boolean")
    a, b = M.clean_metric_events(d).collect()
    assert (a["confidence"], a["rating"], a["processing_time"], a["batch_size"], a["is_cold_start"]) == (0.5, 3.0, 0.0, 1, False)
    assert (b["confidence"], b["rating"], b["is_cold_start"]) == (0.7, 5.0, True) and b["batch_size"] is None and b["processing_time"] is None
    assert [r[0] for r in d.select(X.clip_rating("rating")).collect()] == [3.0, 5.0]


def test_gold_overwrites_only_the_days_it_carries(spark, tmp_path):
    path = str(tmp_path / "gold")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    IO.write_gold(spark.createDataFrame([("d1", 1), ("d2", 1)], "date string, n int"), path)
    IO.write_gold(spark.createDataFrame([("d2", 2)], "date string, n int"), path)
    assert {(r["date"], r["n"]) for r in spark.read.parquet(path).collect()} == {("d1", 1), ("d2", 2)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_best_weights_are_kept_when_the_epochs_end(spark):
    x = spark.createDataFrame([(i, i % 2, 1.0) for i in range(20)], "doc_id long, idx int, weight double")
    y = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, y int")
    flipped = spark.createDataFrame([(i, 1 - i % 2) for i in range(10, 20)], "doc_id long, y int")  # worse with every epoch
    w1, b1, _ = train_modified_huber(x, y, max_epochs=1, valid=flipped)
    w3, b3, _ = train_modified_huber(x, y, max_epochs=3, valid=flipped)
    assert (w1, b1) == (w3, b3)


def _zip_path():
    import pyspark
    found = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "python", "lib", "*.zip"))
    return found


@pytest.mark.skipif(not _zip_path(), reason="no zipped PySpark")
def test_queries_load_from_zipped_pyspark():
    """As under spark-submit: PySpark is a zip and no session exists."""
    code = ("import pyspark, __spark_entry__ as e; assert '.zip' in pyspark.__file__, pyspark.__file__; "
            "q, o = e.queries(), e.oracle_sql(); assert len(q) >= 129 and set(o) <= set(q); print('loaded', len(q))")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*_zip_path(), ROOT])}
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert "loaded" in out.stdout, out.stderr[-2000:]


def test_entry_with_an_empty_conf_folder(tmp_path):
    """No spark-defaults: ``spark.checkpoint.dir`` is unset and must not be set at run time."""
    code = ("from pyspark.sql import SparkSession; import __spark_entry__ as e; "
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
            "print('rows', e.entry(s).count())")
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=200)
    assert "rows" in out.stdout, out.stderr[-2000:]
