"""Structured Streaming forms of ingest, roll-ups, rates, alert hold and scoring (K1-K6).

Every query runs with a checkpoint location under the shared
``spark.checkpoint.dir`` so a restarted driver (or lost executors) resumes
from the last committed micro-batch. ``run_available`` drives a query with
``trigger(availableNow=True)`` and returns the sink as a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedpulse.operators.trend import SENTIMENTS

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_feed(spark: SparkSession, folder: str, schema: str, glob: str | None = None, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """K1: incremental file source (new files are picked up once, tracked by the checkpoint)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    if fmt == "csv":
        from feedpulse.sources.io import CSV_OPTIONS
        r = r.options(**CSV_OPTIONS, multiLine="true")  # drops are files of one task; texts hold line breaks
    return r.load(folder)


def stream_table(spark: SparkSession, folder: str, name: str, schema: str, max_files: int | None = None) -> DataFrame:
    """K1 over a table that is one Parquet file or a folder of them (``sources.tables``).

    The last letter of the path is a pattern: Spark takes a plain path of a stream for a folder, and
    ``pathGlobFilter`` looks at the names of the files only, not of their folder.
    """
    return stream_feed(spark, f"{folder.rstrip('/')}/{name}.parque[t]", schema, max_files=max_files)


def stream_trend(df: DataFrame, ts: str = "ts", topic: str = "topic", sentiment: str = "sentiment",
                 late_delay: str = "1 day") -> DataFrame:
    """K2/K4: tumbling-day trend cube with a watermark (pivot replaced by conditional counts)."""
    s = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late_delay)
    counts = [F.count_if(F.col(sentiment) == v).alias(v) for v in SENTIMENTS]
    g = s.groupBy(F.window(ts, "1 day"), F.col(topic).alias("topic")).agg(*counts)
    total = F.col("Negative") + F.col("Positive") + F.col("Neutral")
    return g.select(F.col("window.start").cast("date").alias("date"), "topic", *SENTIMENTS,
                    total.alias("total_volume"),
                    F.when(total > 0, F.col("Negative") / total).otherwise(F.lit(0.0)).alias("negative_rate"))


def stream_rates(df: DataFrame, keys: Sequence[str], ts: str = "ts", width_seconds: int = 300, slide_seconds: int = 15,
                 late_delay: str = "10 minutes") -> DataFrame:
    """K3: sliding-window event counts and per-second rates, by panes.

    Two chained stateful operators: events are counted into panes of one slide first (a state row per
    key and pane, whatever the number of events), and a closed pane then adds its count to the
    windows that hold it. No event is copied. For append mode: a window is emitted when the watermark has passed its end.
    """
    s = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late_delay)
    panes = s.groupBy(F.window(ts, f"{slide_seconds} seconds"), *keys).agg(F.count(F.lit(1)).alias("n"))
    # the pane's time (its end less a microsecond) carries the watermark on
    panes = panes.select(F.window_time("window").alias("__at"), *keys, "n")
    g = panes.groupBy(F.window("__at", f"{width_seconds} seconds", f"{slide_seconds} seconds"), *keys).agg(F.sum("n").alias("n"))
    return g.select(F.unix_seconds(F.col("window.start")).alias("window_start"), *keys, "n",
                    (F.col("n") / F.lit(float(width_seconds))).alias("rate"))


CLOCK = "__clock"              # the key of rows that only move the watermark on
END_OF_TIME = "9000-01-01"


def rates_to_end(df: DataFrame, key: str, path: str, checkpoint: str, ts: str = "ts", **kw) -> DataFrame:
    """K3 over an input that has come to its end: the rates of every window, the last ones too.

    Append mode keeps the windows that the watermark has not passed. A first run takes all rows of ``df``; then a
    row of a clock series, in a source of its own, goes through the same query and checkpoint, and the watermark
    passes all windows. As it comes in a later micro-batch, no row is late for it. ``df`` has the columns ``ts`` and ``key``.
    """
    spark, clock = df.sparkSession, f"{checkpoint.rstrip('/')}-clock"
    spark.createDataFrame([], df.schema).write.mode("append").parquet(clock)
    rows = df.unionByName(spark.readStream.schema(df.schema).parquet(clock))
    run_available(stream_rates(rows, [key], ts, **kw), path, checkpoint)
    end = spark.range(1).select(F.lit(END_OF_TIME).cast(df.schema[ts].dataType).alias(ts), F.lit(CLOCK).alias(key))
    end.write.mode("append").parquet(clock)
    got = run_available(stream_rates(rows, [key], ts, **kw), path, checkpoint)
    return got.where(~F.col(key).eqNullSafe(CLOCK))


class AlertHold(StatefulProcessor):
    """K5: the J13 run logic of one series, in time order.

    State: the live run (its start and last instant), and the list of instants that wait for the
    watermark. A timer wakes the series when the watermark reaches its next waiting instant, or the next grid
    instant of a live run, so a missing instant ends a run even without new rows. A series without
    run and waiting instants has no state. Without ``event_time`` instants are taken as they arrive.
    """

    def __init__(self, threshold: float, hold: int, step: int, event_time: bool):
        self.threshold, self.hold, self.step, self.event_time = threshold, hold, step, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "run_start long, last_t long")
        self.waiting = handle.getListState("waiting", "t long, value double")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(t), float(v)) for f in rows for t, v in zip(f["t"].tolist(), f["value"].tolist()) if v is not None and v == v]
        yield self._advance(key, new, self._now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._advance(key, [], self._now(timerValues))

    def _now(self, timer_values):
        return timer_values.getCurrentWatermarkInMs() // 1000 if self.event_time else None

    def _advance(self, key, new, now):
        import pandas as pd
        start, last = self.run.get() if self.run.exists() else (None, None)
        held = [(int(t), float(v)) for t, v in self.waiting.get()] if self.waiting.exists() else []
        todo = sorted(held + new)
        later = [p for p in todo if now is not None and p[0] > now]
        rows = []

        def end():
            if last - start >= self.hold:
                rows.append((key[0], last + self.step, "resolved", start))

        for t, v in todo[:len(todo) - len(later)]:
            if start is not None and (t != last + self.step or v <= self.threshold):
                end()  # by a missing instant or a false value
                start = last = None
            if v > self.threshold:
                start, last = (t if start is None else start), t
                rows.append((key[0], t, "firing" if t - start >= self.hold else "pending", start))
        if now is not None and last is not None and last + self.step <= now:
            end()  # the watermark has passed the next instant, and no row came for it
            start = last = None
        self._keep(start, last, later)
        return pd.DataFrame(rows, columns=["series", "t", "state", "active_since"])

    def _keep(self, start, last, later) -> None:
        if start is None:
            self.run.clear()
        else:
            self.run.update((start, last))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if self.event_time:
            wake = [p[0] for p in later] + ([last + self.step] if last is not None else [])
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            if wake:
                self.handle.registerTimer(min(wake) * 1000)

    def close(self) -> None:
        pass


HOLD_SCHEMA = "series string, t long, state string, active_since long"


def stream_alerts(expr: DataFrame, key: str, threshold: float, hold: int, step: int,
                  late_delay: str | None = None) -> DataFrame:
    """K5: stateful alert hold per series over a stream of expression values ``(key, t, value)``.

    ``transformWithStateInPandas`` with the state of ``AlertHold``, kept in RocksDB (``run_available`` sees to that)
    and checkpointed with the query. Without ``late_delay`` the
    instants of one series must arrive in time order across micro-batches (an
    evaluation stream produces them so); inside a micro-batch any order is fine.
    With ``late_delay`` (event-time mode) instants may arrive out of order within
    that bound and are released in order as the watermark passes them. A missing
    instant ends a run; a fired run then reports ``resolved`` at last + step.
    """
    event_time = late_delay is not None
    e = expr.select(F.col(key).alias("series"), "t", F.col("value").cast("double").alias("value"))
    if event_time:
        e = e.withColumn("__ts", F.timestamp_seconds("t")).withWatermark("__ts", late_delay)
    return e.groupBy("series").transformWithStateInPandas(
        AlertHold(threshold, hold, step, event_time), HOLD_SCHEMA, "Append", "EventTime" if event_time else "None")


def stream_score(df: DataFrame, model=None, text_col: str = "clean_text", confidences: bool = False) -> DataFrame:
    """K6: score a stream with a fixed fitted pipeline of ``train_feed`` (or the keyword rules when none)."""
    from feedpulse.operators.scoring import score_feed, score_two_heads
    if model is None:
        return score_feed(df, text_col=text_col)
    return score_two_heads(df, model, text_col) if confidences else score_feed(df, text_col=text_col, feed_model=model)


def pinned_version(spark: SparkSession, root: str, name: str, checkpoint: str) -> int:
    """The version a scoring stream runs with: what the alias pointed to when the stream first started.

    It is written beside the stream's checkpoint, so a restart scores the rest of the input with the
    same version, wherever the alias points by then. A new checkpoint takes the alias's version of its day.
    """
    from feedpulse.operators.nightly import current_version
    path = f"{checkpoint.rstrip('/')}-model"
    try:
        return spark.read.schema("version long").parquet(path).first()["version"]
    except Exception as e:  # the first start
        if "PATH_NOT_FOUND" not in str(e):
            raise
    version = current_version(spark, root, name)
    if version is None:
        raise LookupError(f"no promoted version of {name}")
    spark.createDataFrame([(int(version),)], "version long").coalesce(1).write.parquet(path)
    return int(version)


def run_by_batch(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append every micro-batch over the available input to ``path`` as a partition of its own (``batch_id``).

    A batch that is run again after a failure replaces its own partition, so no row is written twice and
    none is lost.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    q = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def score_available(df: DataFrame, root: str, name: str, path: str, checkpoint: str, text_col: str = "clean_text") -> int:
    """K6 end to end: pin the version, load it, score what is available, write it by batch. Returns the version."""
    from feedpulse.operators.nightly import load_version
    spark = df.sparkSession
    version = pinned_version(spark, root, name, checkpoint)
    run_by_batch(stream_score(df, load_version(spark, root, name, version), text_col, confidences=True), path, checkpoint)
    return version


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all available input, then read its Parquet sink.

    ``append`` writes new rows to the sink; ``complete`` replaces the sink
    table with each micro-batch's full result (foreachBatch, idempotent by batch).
    """
    spark = df.sparkSession
    if mode == "complete":
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        q = df.writeStream.outputMode("complete").foreachBatch(write)
    else:
        q = df.writeStream.outputMode("append").format("parquet").option("path", path)
    _start(q.option("checkpointLocation", checkpoint).trigger(availableNow=True), spark).awaitTermination()
    return spark.read.parquet(path)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, spark: SparkSession):
    """Start a query whose state is kept in RocksDB (a query keeps the settings it was started under; the
    session's own are as before)."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_update_to_gold(df: DataFrame, path: str, checkpoint: str, keys=("date", "topic"),
                       available_now: bool = True):
    """K2 sink for long-running streams: update mode, each micro-batch rewrites only the
    gold partitions of the (day, topic) rows it changed (dynamic partition overwrite).

    State stays bounded because the watermark evicts closed days; the gold table always
    holds the latest counts. Returns the streaming query (finished when ``available_now``).
    """
    from feedpulse.sources.io import write_gold

    def write(batch: DataFrame, _epoch: int) -> None:
        write_gold(batch, path, list(keys))

    q = (df.writeStream.outputMode("update").foreachBatch(write)
           .option("checkpointLocation", checkpoint))
    q = (q.trigger(availableNow=True) if available_now else q).start()
    if available_now:
        q.awaitTermination()
    return q
