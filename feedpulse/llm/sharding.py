"""Operator 8, sharding: sampled splitters (DataFrame functions only).

The key of a record puts equal texts side by side: 40 bits of the text's hash, then 24 bits of
the record's own hash, so that a text held by a third of all rows still has 2^24 places to cut.
A size-weighted sample of keys gives quantile boundaries in two levels: a fixed number of coarse
ranges, whose boundaries are all that the driver and the plan hold, and inside each as many as its
counted rows need, whose boundaries Spark works out and keeps as a table. The records are range-partitioned by
them, ranges found overfull by exact counts are subdivided by new samples, and every record gets
its exact place in the byte sequence from the totals before its range and the running total
inside it. That place decides the shard, so shard sizes differ by less than one record.

Defined results: a null text has size 1 and the CRC of nothing; null and repeated ids and repeated
rows are records of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from feedpulse.llm.common import release, stored

COARSE_RANGES = 256        # whatever the number of rows
ROWS_PER_RANGE = 250_000   # rows that one window task sorts, about
SMALL_RANGES = 1_000_000   # ranges up to which the tables of boundaries and totals (8 to 32 bytes each) are broadcast
DRAWS_PER_RANGE = 16       # expected sample size: this times the number of ranges
_LOOKUP = 64               # boundaries below one coarse step of the search


def _range_of(cuts: list[int], key: Column) -> Column:
    """Number of ``cuts`` not above ``key``: a search in two steps, about 2 * 64 comparisons for 4096 cuts."""
    if not cuts:
        return F.lit(0)
    step = max(_LOOKUP, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    below = lambda a: F.size(F.filter(a, lambda b: b <= key))
    longs = lambda xs: F.expr("array(" + ",".join(f"cast({x} as bigint)" for x in xs) + ")")
    if len(groups) == 1:
        return below(longs(groups[0]))
    coarse = below(longs([g[0] for g in groups]))
    inside = F.get(F.array(*[longs(g) for g in groups]), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(inside))


def _sample(rows: DataFrame, weight: Column, total: int, draws: int, seed: int) -> list[tuple[int, float]]:
    """(key, weight) of an expected ``draws`` records at most twice, by weight; the driver holds no more."""
    share = weight * F.lit(float(draws)) / F.lit(float(total))
    u = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.filter(u < share).select("key", F.greatest(share, F.lit(1.0)).alias("w")).collect()
    return sorted((r["key"], r["w"]) for r in got)


def _quantiles(sample: list[tuple[int, float]], n: int) -> list[int]:
    """Keys that cut the sample's weight into ``n`` equal parts."""
    total, run, cuts = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        run += w
        while len(cuts) < n - 1 and run >= total * (len(cuts) + 1) / n:
            cuts.append(key)
    return sorted(set(cuts))


def _inner(cuts: Column, key: Column, most: int) -> Column:
    """How many of the sorted array ``cuts`` (``most`` at most) are not above ``key``: binary search in the row."""
    bits = F.lit([1 << b for b in reversed(range(max(most, 1).bit_length()))])
    return F.aggregate(bits, F.lit(0), lambda at, bit: at + F.when(F.coalesce(F.get(cuts, at + bit - 1) <= key, F.lit(False)), bit).otherwise(0))


def _cuts(rows: DataFrame, by: list[str], weight: Column, seed: int, rows_per_range: int) -> DataFrame:
    """(coarse, cuts): boundaries inside the ranges ``by`` (rows carry the range's ``held_rows`` and ``held_weight``),
    quantiles of a weighted sample of about DRAWS_PER_RANGE records for each range to come."""
    parts = F.ceil(F.col("held_rows") / F.lit(rows_per_range))
    share = weight * parts * DRAWS_PER_RANGE / F.col("held_weight")
    u = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter((parts > 1) & (u < share)).select(*by, "key", "tie", parts.alias("parts"), F.greatest(share, F.lit(1.0)).alias("w"))
    one = Window.partitionBy(*by)  # a range's sample
    run = F.sum("w").over(one.orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    step = F.col("parts") / F.sum("w").over(one)
    d = drawn.select(*by, "key", F.floor(run * step).alias("now"), F.floor((run - F.col("w")) * step).alias("before"), "parts")
    d = d.filter((F.col("now") > F.col("before")) & (F.col("before") < F.col("parts") - 1))
    return d.groupBy("coarse").agg(F.array_sort(F.collect_set("key")).alias("cuts"))


def _small(table: DataFrame, ranges: int) -> DataFrame:
    """Broadcast while the number of ranges is small; joined by shuffle beyond."""
    return F.broadcast(table) if ranges <= SMALL_RANGES else table


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
          rows_per_range: int = ROWS_PER_RANGE, coarse_ranges: int = COARSE_RANGES) -> DataFrame:
    """Every record with its ``shard`` (0 to n_shards - 1, sizes near equal) and ``slot`` (gapless from 0)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
                       F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("tie"))
    low = F.shiftrightunsigned(F.xxhash64("doc_id", "tie", F.lit(1)), 40)
    rows = stored(rows.select("doc_id", "size", "text_crc32", "tie",
                              F.shiftleft(F.shiftright("h", 24), 24).bitwiseOR(low).alias("key")), "shard-records")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))

    coarse = _quantiles(_sample(rows, F.col("size"), total, DRAWS_PER_RANGE * coarse_ranges, 7), coarse_ranges)
    rows = rows.withColumn("coarse", _range_of(coarse, F.col("key")))
    counts = rows.groupBy("coarse").agg(F.count(F.lit(1)).alias("held_rows"), F.sum("size").alias("held_weight"))  # one row per coarse range
    cuts = stored(_cuts(rows.join(F.broadcast(stored(counts, "shard-coarse")), "coarse"), ["coarse"], F.col("size"), 8, rows_per_range), "shard-cuts")
    for seed in range(9, 40):  # each turn cuts what is overfull; one or two turns do
        ranges, most = cuts.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0)), F.coalesce(F.max(F.size("cuts")), F.lit(0))).first()
        inner = _inner(F.col("cuts"), F.col("key"), most)
        ranged = rows.join(_small(cuts, ranges), "coarse", "left").withColumn("inner", F.coalesce(inner, F.lit(0))).drop("cuts")
        held = stored(ranged.groupBy("coarse", "inner").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-ranges")
        over = held.filter(F.col("rows") > 4 * max(rows_per_range, 16)).select(
            "coarse", "inner", F.col("rows").alias("held_rows"), F.col("rows").cast("double").alias("held_weight"))
        if over.isEmpty():
            break
        new = _cuts(ranged.join(_small(over, ranges), ["coarse", "inner"]), ["coarse", "inner"], F.lit(1.0), seed, rows_per_range)
        new = stored(cuts.unionByName(new).groupBy("coarse").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts")), "shard-cuts")
        if new.agg(F.sum(F.size("cuts"))).first()[0] == ranges:  # copies of one key only
            break
        cuts = new

    # totals before a range: of the coarse ranges before (a fixed number of rows), and inside its own
    sums = held.groupBy("coarse").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    earlier = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("coarse", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("b", "r")])
    own = Window.partitionBy("coarse").orderBy("inner").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.join(F.broadcast(sums), "coarse").select(
        "coarse", "inner", (F.col("b") + F.coalesce(F.sum("bytes").over(own), F.lit(0))).alias("bytes_before"),
        (F.col("r") + F.coalesce(F.sum("rows").over(own), F.lit(0))).alias("rows_before"))
    inside = Window.partitionBy("coarse", "inner").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (ranged.withColumn("b", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .withColumn("r", F.count(F.lit(1)).over(inside))
              .join(_small(offsets, ranges), ["coarse", "inner"])
              .select("doc_id", "size", "text_crc32",
                      F.least(F.lit(n_shards - 1), F.floor(
                          (2 * (F.col("bytes_before") + F.col("b")) + F.col("size")) * F.lit(n_shards) / F.lit(2 * total)
                      )).cast("int").alias("shard"),
                      (F.col("rows_before") + F.col("r")).alias("place")))
    placed = stored(placed, "shard-places")
    release(spark)
    first = {r["shard"]: r["place"] for r in placed.groupBy("shard").agg(F.min("place").alias("place")).collect()}
    start = F.coalesce(*[F.when(F.col("shard") == s, F.lit(p)) for s, p in first.items()]).cast("bigint")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - start).alias("slot"))
