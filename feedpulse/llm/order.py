"""Global row numbers without a task that sees all rows, or all rows of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.llm.common import free_name, stored

_ROWS = 33  # monotonically_increasing_id: partition number above, row number below


def ranked(df: DataFrame, order: Sequence[Column], name: str, out: str = "r", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, all by default) with ``out``: each row's place in ``order``, from 0 (nulls first; rows that tie in all of
    ``order`` are numbered as they come). Rows are split at sampled splitters, ties included, sorted
    inside each range and written once, so a retry cannot number them anew; the only rows that meet
    are one count per range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = list(keep or df.columns)
    cols = [free_name(df.columns, f"o{i}") for i in range(len(order))]
    tie, at, base = (free_name(df.columns, c) for c in ("tie", "at", "base"))
    keyed = df.select(*keep, *[c.alias(o) for c, o in zip(order, cols)], F.monotonically_increasing_id().alias(tie))
    rows = stored(keyed.repartitionByRange(n, *cols, tie).sortWithinPartitions(*cols, tie)
                       .select(*keep, F.monotonically_increasing_id().alias(at)), name)
    part = F.shiftright(at, _ROWS).cast("int")
    prior = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = (rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
                   .select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(prior), F.lit(0)).alias(base)))
    return (rows.join(F.broadcast(offsets), part == F.col("__part"))
                .select(*keep, (F.col(base) + F.col(at).bitwiseAND((1 << _ROWS) - 1)).alias(out)))
