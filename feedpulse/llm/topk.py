"""Operator 7, exact top-k search: a bit-sliced index.

Vectors become integers. The index holds blocks of rows; in a block, each quantised component
(value >> SHIFT, less the block's least) is a set of bitmaps over the rows, one per bit. A query's
scores are then sums of bitmaps: every signed binary digit of its quantised weights adds a slice
(inverted for a negative digit) at that digit's place, and carry-save adders count all slices of
one place with whole-word AND, OR and XOR. The sum's own slices are read from the most
significant down to find the (k + 1)-th largest sum; rows whose sum is within the quantisation
error of it (the boundary) are scored exactly with integers, all others cannot be among the best.

Every finite vector takes part. Those with a component of ``WIDE`` or more in size have blocks of their
own, quantised more coarsely; their boundary rows are scored with integers of any length, so results stay exact.

Queries and blocks meet in (block, group of queries) pairs of bounded size, each a task of its own; each
pair returns at most k rows a query, and a ranked window per query merges them.

Defined results: vectors that are null, or hold a null or a non-finite component, and rows without an
id, take no part; vectors of other lengths count as padded with zeros; repeated ids are rows of their
own (a query skips only its own row); an empty table gives no rows; other columns are ignored. Ranks follow the
exact scores; a score beyond 64 bits is shown as the nearest 64-bit number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.llm.common import ship_code, stored

BLOCK_ROWS = 16_384
GROUP_QUERIES = 256
MAX_TASKS = 20_000
WIDE = 65_536      # components from here on are kept as they are, and scored with long integers
SHIFT = 5          # bits cut off a component, at least
WEIGHT_SHIFT = 2   # bits cut off a query's weight, at least
VALUE_BITS, WEIGHT_BITS = 22, 24  # what remains of wide ones
INDEX = "block bigint, n int, dims int, uids binary, ids binary, ints binary, wide binary, shift int, planes binary, widths binary, least binary"
# scores of any size in order: as 64-bit numbers, then, beyond those, by ``over``
HITS = "query_uid bigint, query_id bigint, vec_id bigint, uid bigint, score bigint, over binary"
_LEAST, _MOST = -2**63, 2**63 - 1
_OVER_BITS = 2_240  # no sum of products of doubles times 1024 has more, for up to 2**100 components


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """uid (one per row), vec_id and ints = floor(1024 * x) of the vectors that take part, or, where a
    component is wide, the vector itself as ``wide``."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    wide = F.exists(v, lambda x: F.abs(x) >= WIDE)
    return (vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(whole)
            .select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("vec_id"),
                    F.when(~wide, F.transform(v, lambda x: F.floor(x.cast("double") * 1024).cast("int"))).alias("ints"),
                    F.when(wide, v.cast("array<double>")).alias("wide")))


def exact(values) -> np.ndarray:
    """floor(1024 * x) of finite numbers, as integers of any length."""
    return np.array([math.floor(x * 1024) if abs(x) < 2.0**1000 else int(x) * 1024 for x in values], dtype=object)


def _matrix(lists, dims: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((len(lists), dims), dtype=kind)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def _bits(m: np.ndarray) -> int:
    """Bits of the largest of integers of any length."""
    return max((abs(int(x)).bit_length() for x in m.flat), default=0)


def build_block(block: int, uids: np.ndarray, ids: np.ndarray, m: np.ndarray, wide: np.ndarray | None = None) -> tuple:
    """The bit slices of one block of rows; a block of wide ones holds integers of any length in ``m``."""
    shift = SHIFT if wide is None else max(SHIFT, _bits(m) - VALUE_BITS)
    q = m >> shift if wide is None else (m >> shift).astype(np.int64)
    least = q.min(axis=0) if m.shape[1] else np.zeros(0, np.int64)
    q = q - least
    widths = np.array([int(x).bit_length() for x in q.max(axis=0)] if m.shape[1] else [], dtype=np.int64)
    pad = -len(m) % 64
    planes = []
    for j, w in enumerate(widths):
        for b in range(w):
            bits = np.concatenate([(q[:, j] >> b) & 1, np.zeros(pad, np.int64)]).astype(np.uint8)
            planes.append(np.packbits(bits, bitorder="little"))
    data = np.concatenate(planes).tobytes() if planes else b""
    return (block, len(m), m.shape[1], uids.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(),
            m.astype(np.int32).tobytes() if wide is None else b"", b"" if wide is None else wide.tobytes(), shift,
            data, widths.tobytes(), least.tobytes())


def build_index(ints: DataFrame, n_blocks: int, n_wide: int = 0) -> DataFrame:
    """One row per block of about ``BLOCK_ROWS`` rows, dealt out by hash; the last ``n_wide`` blocks hold the wide rows."""
    ship_code(ints.sparkSession)

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("uid")
        block, uids, ids = int(f["block"].iloc[0]), f["uid"].to_numpy(), f["vec_id"].to_numpy()
        if f["wide"].notna().any():
            raw = _matrix(f["wide"], max(map(len, f["wide"])), np.float64)
            row = build_block(block, uids, ids, np.array([exact(x) for x in raw], dtype=object).reshape(raw.shape), raw)
        else:
            row = build_block(block, uids, ids, _matrix(f["ints"], max(map(len, f["ints"]))))
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    place = F.xxhash64("uid", "vec_id")
    block = F.when(F.col("wide").isNull(), F.pmod(place, F.lit(n_blocks))).otherwise(F.lit(n_blocks) + F.pmod(place, F.lit(max(1, n_wide))))
    return ints.withColumn("block", block).groupBy("block").applyInPandas(build, INDEX)


def digits(w: int) -> list[tuple[int, int]]:
    """(place, +1 or -1) of the non-adjacent form of a weight: no two digits are neighbours."""
    out, place, sign = [], 0, 1 if w >= 0 else -1
    w = abs(w)
    while w:
        if w & 1:
            d = 2 - (w & 3)
            out.append((place, d * sign))
            w -= d
        w >>= 1
        place += 1
    return out


class Block:
    """One row of the index, ready for queries."""

    def __init__(self, row):
        self.n, self.dims = int(row.n), int(row.dims)
        self.uids, self.ids = np.frombuffer(row.uids, np.int64), np.frombuffer(row.ids, np.int64)
        self.shift, self.wide = int(row.shift), len(row.wide) > 0
        if self.wide:
            raw = np.frombuffer(row.wide, np.float64).reshape(self.n, self.dims)
            self.ints = np.array([exact(x) for x in raw], dtype=object).reshape(raw.shape)
        else:
            self.ints = np.frombuffer(row.ints, np.int32).reshape(self.n, self.dims)
        widths, self.least = np.frombuffer(row.widths, np.int64), np.frombuffer(row.least, np.int64)
        words = -(-self.n // 64)
        flat = np.frombuffer(row.planes, np.uint64).reshape(-1, words) if words else np.zeros((0, 0), np.uint64)
        at = np.concatenate([[0], np.cumsum(widths)]).astype(int)
        self.planes = [flat[at[j]:at[j + 1]] for j in range(self.dims)]
        self.rows = np.full(words, ~np.uint64(0))
        if self.n % 64:
            self.rows[-1] = (np.uint64(1) << np.uint64(self.n % 64)) - np.uint64(1)
        self.inverse = [~p for p in self.planes]
        kind = object if self.wide else np.int64
        self.low, self.high = (self.ints.min(axis=0).astype(kind), self.ints.max(axis=0).astype(kind)) if self.n else (None, None)

    def sums(self, weights: list[int]) -> list[np.ndarray]:
        """Slices, least first, of the sum over components of weight * quantised value, up to a constant:
        a digit -1 adds the inverted slice (1 - bit instead of -bit)."""
        places: list[list[np.ndarray]] = []
        for j, w in enumerate(weights):
            for place, sign in digits(w):
                for b, plane in enumerate(self.planes[j] if sign > 0 else self.inverse[j]):
                    while len(places) <= place + b:
                        places.append([])
                    places[place + b].append(plane)
        out, i = [], 0
        while i < len(places):
            own = places[i]
            if i + 1 == len(places) and len(own) > 1:
                places.append([])
            while len(own) > 2:  # three slices of one place become one here and one of the next
                a, b, c = own.pop(), own.pop(), own.pop()
                x = a ^ b
                own.insert(0, x ^ c)
                places[i + 1].append((a & b) | (x & c))
            if len(own) == 2:
                a, b = own
                own[:] = [a ^ b]
                places[i + 1].append(a & b)
            out.append(own[0] if own else np.zeros_like(self.rows))
            i += 1
        return out

    def best(self, query: np.ndarray, uid: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the k best rows but ``uid``; ties to the smaller id."""
        wide = self.wide or query.dtype == object
        q = np.zeros(self.dims, object if wide else np.int64)
        q[:min(len(query), self.dims)] = query[:self.dims]
        cut_off = max(WEIGHT_SHIFT, _bits(q) - WEIGHT_BITS) if wide else WEIGHT_SHIFT
        weights = np.where(q >= 0, q >> cut_off, -((-q) >> cut_off))
        rest = q - (weights << cut_off)
        slices = self.sums([int(w) for w in weights])
        # score = 2^(shift + cut_off) * sum + constant + error; the error's range, by component:
        cut = (weights << cut_off) * ((1 << self.shift) - 1)
        err = int(np.abs(cut).sum() + np.abs(rest * self.low - rest * self.high).sum())
        near = -(-err // (1 << (self.shift + cut_off)))
        rows = self._from(slices, max(0, self._kth(slices, min(k + 1, self.n)) - near))
        scores = self.ints[rows].astype(object if wide else np.int64) @ q
        mine = self.uids[rows] != uid
        rows, scores = rows[mine], scores[mine]
        if wide:
            order = np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]], self.uids[rows[i]]))[:k], dtype=np.int64)
        else:
            order = np.lexsort((self.uids[rows], self.ids[rows], -scores))[:k]
        return rows[order], scores[order]

    def _kth(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest sum: decide its bits from the most significant slice downward."""
        equal, above, value = self.rows, 0, 0
        for i in range(len(slices) - 1, -1, -1):
            ones = equal & slices[i]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                equal, value = ones, value | 1 << i
            else:
                above += n
                equal = equal & ~slices[i]
        return value

    def _from(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        """Numbers of the rows whose sum is at least ``least``."""
        more, equal = np.zeros_like(self.rows), self.rows
        if least >> len(slices):
            return np.zeros(0, np.int64)
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & slices[i]
            else:
                more = more | (equal & slices[i])
                equal = equal & ~slices[i]
        return np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little"))


def _shown(scores: np.ndarray) -> dict:
    """``score`` and ``over`` of exact scores: in their order they sort as the scores do."""
    if scores.dtype != object:
        return {"score": scores, "over": [b"\x80"] * len(scores)}
    over = [b"\x80" if _LEAST <= x <= _MOST else (b"\xff" if x > 0 else b"\x00") + (x + (1 << _OVER_BITS)).to_bytes(_OVER_BITS // 8 + 1, "big")
            for x in map(int, scores)]
    return {"score": [min(max(int(x), _LEAST), _MOST) for x in scores], "over": over}


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k best other rows. ``is_query`` is a
    condition on ``vec_id``."""
    ints = stored(integers(vectors, id_col, vec_col), "topk-integers")
    n, n_wide, n_queries = ints.agg(F.count("ints"), F.count("wide"), F.count_if(is_query)).first()
    n_blocks, wide_blocks, n_groups = max(1, -(-n // BLOCK_ROWS)), -(-n_wide // BLOCK_ROWS), max(1, -(-n_queries // GROUP_QUERIES))
    index = stored(build_index(ints, n_blocks, wide_blocks), "topk-index")
    last = n_blocks + wide_blocks - 1
    queries = ints.filter(is_query).withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(n_groups)))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    blocks = index.withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_groups - 1).cast("bigint"))))
    # a number of tasks by the work, which bytes do not tell
    tasks = min(MAX_TASKS, (last + 1) * n_groups)
    queries, blocks = queries.repartition(tasks, "block", "g"), blocks.repartition(tasks, "block", "g")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in HITS.split(", ")]
        out = []
        if len(left) and len(right):
            block = Block(next(left.itertuples()))
            for q in right.itertuples():
                rows, scores = block.best(np.asarray(q.ints, dtype=np.int64) if q.wide is None else exact(q.wide), q.uid, k)
                out.append(pd.DataFrame({"query_uid": q.uid, "query_id": q.vec_id, "vec_id": block.ids[rows],
                                         "uid": block.uids[rows], **_shown(scores)}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="object" if c == "over" else "int64") for c in names})

    hits = blocks.groupBy("block", "g").cogroup(queries.groupBy("block", "g")).applyInPandas(find, HITS)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.desc("over"), "vec_id", "uid")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
