"""Reproducible train/test splits (E1, E2) keyed by a hash of the row key.

md5 of ``seed|key`` gives the same order in any engine, so a split can be
re-derived exactly. Neither split sorts a whole class in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.operators.ordering import join_null_safe
from feedpulse.session import written

STRATA_BITS = 20


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """First 32 bits of md5(seed|k1|k2...) as a non-negative bigint."""
    s = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def split_random(df: DataFrame, keys: Sequence[str], test_frac: float = 0.2, seed: int = 42,
                 out: str = "is_test") -> DataFrame:
    """A row is in the test set when its hash falls below ``test_frac`` of the range."""
    return df.withColumn(out, key_hash(keys, seed) < F.lit(int(test_frac * (1 << 32))))


def split_stratified(df: DataFrame, keys: Sequence[str], label: str, test_frac: float = 0.2,
                     seed: int = 42, out: str = "is_test") -> DataFrame:
    """Per label, the ceil(test_frac * n_label) rows with the smallest (hash, key) are test.

    Exact, and equal to ``row_number() over (partition by label order by hash, key)``,
    but computed by hash bucket: bucket counts give a running offset per label, and only the keys in the
    one bucket that holds the cut are ranked. The last test row's (hash, key) is then a bound that
    each row is compared with where it is; no row with its text is moved.
    """
    h, at = "__h", F.struct("__h", *keys)
    d = df.withColumn(h, key_hash(keys, seed)).withColumn("__b", F.shiftright(F.col(h), 32 - STRATA_BITS))
    counts = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w_cum = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counts = (counts.withColumn("__cum", F.sum("__n").over(w_cum))
                    .withColumn("__need", F.ceil(F.sum("__n").over(Window.partitionBy(label)) * F.lit(test_frac)))
                    .withColumn("__rank", F.col("__need") - F.col("__cum") + F.col("__n")))
    # the bucket of a label that holds its last test row, and that row's place in it
    cut = counts.where((F.col("__rank") > 0) & (F.col("__cum") >= F.col("__need"))).select(label, "__b", "__rank")
    w = Window.partitionBy(label).orderBy(h, *keys)
    inside = join_null_safe(d.select(label, h, "__b", *[k for k in keys if k != label]), cut, [label, "__b"])
    last = inside.select(label, "__rank", at.alias("__cut"), F.row_number().over(w).alias("__rk"), F.lead(at).over(w).alias("__next"))
    last = written(last.where("__rk = __rank").select(label, "__cut", F.col("__cut").eqNullSafe(F.col("__next")).alias("__tie")), "split-cuts")
    cols = df.columns + [out]
    j = join_null_safe(d, last, [label], "left")
    if last.where("__tie").isEmpty():
        return j.withColumn(out, F.coalesce(at <= F.col("__cut"), F.lit(False))).select(*cols)
    # keys that name several rows, cut apart: only those rows are ranked
    same = F.coalesce(at == F.col("__cut"), F.lit(False))
    rest = j.where(~same).withColumn(out, F.coalesce(at <= F.col("__cut"), F.lit(False)))
    below = join_null_safe(d, cut, [label, "__b"]).join(last.select(F.col(label).alias("__l"), "__cut"), F.col(label).eqNullSafe(F.col("__l")))
    taken = below.groupBy(label).agg((F.max("__rank") - F.count_if(at < F.col("__cut"))).alias("__take"))
    ties = join_null_safe(j.where(same), taken, [label]).withColumn(out, F.row_number().over(Window.partitionBy(label).orderBy(h)) <= F.col("__take"))
    return rest.select(*cols).unionByName(ties.select(*cols))
