"""Order-dependent numbering that stays parallel when one key is hot.

A plain ``row_number() over (partition by key order by ts)`` sends every row of
a key to one task; with a key that holds a third of the data that task holds a
third of the data. The helpers below split the work by sampled ranges, number
rows inside each range, and add an offset computed on the (small) table of
per-range counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.session import ensure_checkpoint_dir, written


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null keys match each other; the keys appear once, from the left."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


MAX_SLICES = 4095  # time slices of a job: numbers that the driver and the plan hold


def time_splits(df: DataFrame, ts: str, slices: int | None = None) -> list[int]:
    """Times (microseconds) that cut the rows of ``df`` into slices of about equal size, whatever the keys.

    One aggregate over the time column; the few numbers it gives are fixed from then on, so a retry
    cannot cut anew. Rows of one time are never cut apart.
    """
    n = slices or min(MAX_SLICES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    got = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)] or [0.5], 100 * n).alias("q")).first()["q"]
    return sorted(set(got or []))


def slice_of(ts: Column, splits: Sequence[int]) -> Column:
    """Number of the row's slice: how many of ``splits`` are not after it (binary search in the row)."""
    bits = max(len(splits), 1).bit_length()
    table = F.lit([*splits, *[2**63 - 1] * ((1 << bits) - 1 - len(splits))]).cast("array<bigint>")
    x = F.unix_micros(ts.cast("timestamp"))
    steps = F.lit([1 << b for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda pos, bit: pos + F.when(F.get(table, pos + bit - 1) <= x, bit).otherwise(0))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys`` together, in as many partitions as a shuffle has: for sorts of long rows with few different
    texts, which AQE would put into a few large tasks, as it merges partitions by their compressed size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "value",
                  splits: Sequence[int] | None = None) -> DataFrame:
    """``count(*) over (partition by keys order by order)`` (rows frame, 1-based).

    ``order`` begins with a time. Rows meet by (keys, time slice), so a key that holds a third of all
    rows is spread over the slices (``splits``, sampled from ``df`` by default); the offset of a
    slice is the running sum of the counts of the key's earlier ones. Null keys are keys.
    """
    keys = list(keys)
    p = "__slice"
    splits = time_splits(df, order[0]) if splits is None else splits
    d = spread(df.withColumn(p, slice_of(F.col(order[0]), splits)), [*keys, p])
    counts = d.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__n"))
    prior = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(prior), F.lit(0))).drop("__n")
    d = d.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, p).orderBy(*order)))
    return (join_null_safe(d, offsets, keys + [p])
             .withColumn(out, F.col("__off") + F.col("__local"))
             .drop(p, "__local", "__off"))


def dense_index(values: DataFrame, col: str, out: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """Sorted distinct values of ``col`` numbered 0..n-1 (ascending).

    Range-partition the distinct values, number them inside each range
    partition, and add the count of all lower partitions. No step moves all
    values into one task.
    """
    d = values.select(col).where(F.col(col).isNotNull()).distinct()
    ensure_checkpoint_dir(values.sparkSession)
    n = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (d.repartitionByRange(n, F.col(col))
               .withColumn("__pid", F.spark_partition_id()))
    # materialise the range assignment once so retries cannot re-draw it
    ranged = ranged.checkpoint(eager=True)
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    prior = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: a bounded table, safe to window globally
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(prior), F.lit(0))).drop("__n")
    local = Window.partitionBy("__pid").orderBy(col)
    return (ranged.withColumn("__local", F.row_number().over(local))
                  .join(F.broadcast(offsets), "__pid")
                  .select(col, (F.col("__off") + F.col("__local") - 1).cast("bigint").alias(out)))


def rank_table(values: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Distinct values of ``col`` (``v``) with their counts (``c``), how many values are ``before`` them, and, of all
    values, ``total``, ``mean``, ``lo`` and ``hi``; nulls are left out.

    The distinct values are range-partitioned and written once (a retry cannot draw other ranges); a range's offset and
    the whole's figures come from a table of one row per range. No task holds more than one range.
    """
    spark = values.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (values.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
                    .groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    ranged = written(counts.repartitionByRange(n, "v").withColumn("__pid", F.spark_partition_id()), "rank-table")
    sizes = ranged.groupBy("__pid").agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # one row per range partition: a bounded table, safe to window globally and to broadcast
    prior, whole = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sizes = sizes.select("__pid", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("__off"), F.sum("n").over(whole).alias("total"),
                         (F.sum("s").over(whole) / F.sum("n").over(whole)).alias("mean"), F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"))
    local = Window.partitionBy("__pid").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("__below", F.coalesce(F.sum("c").over(local), F.lit(0))).join(F.broadcast(sizes), "__pid")
                  .select("v", "c", (F.col("__off") + F.col("__below")).alias("before"), "total", "mean", "lo", "hi"))


def quantile_of_ranks(q: float) -> Column:
    """An aggregate over ``rank_table``: the quantile at rank q * (total - 1), linear between two values."""
    at = F.lit(float(q)) * (F.col("total") - 1)
    hit = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
    low, high = F.max(F.when(hit(F.floor(at)), F.col("v"))), F.max(F.when(hit(F.ceil(at)), F.col("v")))
    return low + (high - low) * F.max(at - F.floor(at))


def exact_quantiles(values: DataFrame, col: str, qs, partitions: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (one row ``q0, q1, ...``), fully distributed.

    Values are counted and range-partitioned; no task holds more than one range
    of distinct values, unlike a single-task percentile merge.
    """
    return rank_table(values, col, partitions).agg(*[quantile_of_ranks(q).alias(f"q{i}") for i, q in enumerate(qs)])
