"""Operator 5, best-fit packing by linear grouping.

Tasks tokenise whole texts, cut documents that are longer than a sequence and return one row per
piece (its length, CRC and place, not its ids). What decides the packing is only how many pieces
have each length: at most ``capacity`` numbers, whatever the input's size. The driver solves that:

* linear grouping: the large lengths, sorted, are divided into groups of equal cardinality and
  rounded up to the group's largest, so that few sizes are left;
* configurations: for the largest size left, a subset-sum over the other sizes finds the fullest
  configuration; it is used as often as the counts allow, until no large size is left;
* substitution: the actual pieces of a group take the places of their rounded size;
* best-fit: small lengths, in falling order, go where the least room is left that takes them.

All steps work on runs (so many pieces of one length, from such a rank on), so the plan is a short
table as well. Each piece finds its sequence and offset by its rank among the pieces of its length;
ranks are counted per writing task and made global by the totals of the tasks before.

Defined results: a null or empty text is the end id alone; repeated ids and rows are documents of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.llm.common import release, ship_code, stored

CAPACITY = 2048
GROUPS = 256        # sizes that the large lengths are rounded up to
LARGE = 8           # a length is large above capacity / LARGE
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary as ranks
END_ID = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"

_PLAIN = re.compile(r"[^\t\n\r -~¡-ɏ]")  # a character outside these goes to the reference encoder
_ENCODERS: dict = {}


def encoder(tokenizer: str = TOKENIZER, ranks: str | None = RANKS):
    """text -> ids of a public tokenizer file. With the same vocabulary as a rank file, texts of plain
    Latin characters without special strings take the faster encoder, which gives the same ids."""
    if (tokenizer, ranks) not in _ENCODERS:
        from tokenizers import Tokenizer
        slow = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        fast = None
        if ranks:
            import tiktoken
            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if fast is None or _PLAIN.search(text) or any(s in text for s in special):
                return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)

        _ENCODERS[tokenizer, ranks] = encode
    return _ENCODERS[tokenizer, ranks]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens: full pieces, of which the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """One row per piece; ``rank`` counts the pieces of one length within the task ``part``."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(tokenizer, ranks), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((None if pd.isna(doc) else int(doc), piece, start, length,
                                zlib.crc32(ids[start:start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            f = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            f["doc_id"] = f["doc_id"].astype("Int64")
            yield f

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, PIECES)


# ------------------------------------------------------------------ the plan, on counts by length

def _fullest(first: int, sizes: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    """``first`` with the sizes that fill the sequence most (subset sum over bit sets of sums)."""
    room, reach, layers = capacity - first, 1, []
    mask = (1 << room + 1) - 1
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(counts[s] - (s == first), room // s)):
            new = (reach | reach << s) & mask
            if new == reach:
                break
            layers.append((s, reach))
            reach = new
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, [first]
    for s, before in reversed(layers):
        if not before >> at & 1:
            out.append(s)
            at -= s
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE) -> tuple[list[tuple], int]:
    """Rows (length, first, count, per, sequence, offset) and the number of sequences: the pieces of
    ``length`` with ranks first .. first + count - 1 go to sequences from ``sequence`` on, ``per`` to
    each, side by side from ``offset``."""
    rows, used = [], 0
    room: dict[int, list[tuple[int, int]]] = {}   # room left -> (first sequence, how many)
    next_rank = {n: 0 for n in hist}

    big = [(n, hist[n]) for n in sorted(hist, reverse=True) if n > capacity // large]
    each = -(-sum(c for _, c in big) // groups)
    queues: dict[int, list[list[int]]] = {}       # rounded size -> runs [length, count], longest first
    size, held = 0, 0
    for n, c in big:
        while c:
            if not size or held == each:
                size, held = n, 0
            k = min(c, each - held)
            queues.setdefault(size, []).append([n, k])
            held, c = held + k, c - k
    counts = {s: sum(k for _, k in q) for s, q in queues.items()}
    sizes = sorted(counts, reverse=True)
    while sizes:
        config = _fullest(sizes[0], sizes, counts, capacity)
        need = {s: config.count(s) for s in config}
        times = min(counts[s] // k for s, k in need.items())
        slots = []
        for s in config:                          # the actual pieces that take each place
            runs, left = [], times
            while left:
                n, k = queues[s][0]
                take = min(k, left)
                runs.append([n, take])
                left -= take
                if take == k:
                    queues[s].pop(0)
                else:
                    queues[s][0][1] -= take
            slots.append(runs)
        done = 0
        while done < times:                       # sequences between two changes of any place's length
            k = min(r[0][1] for r in slots)
            at = 0
            for r in slots:
                n = r[0][0]
                rows.append((n, next_rank[n], k, 1, used + done, at))
                next_rank[n] += k
                at += n
                r[0][1] -= k
                if not r[0][1]:
                    r.pop(0)
            if at < capacity:
                room.setdefault(capacity - at, []).append((used + done, k))
            done += k
        used += times
        for s, k in need.items():
            counts[s] -= times * k
        sizes = [s for s in sizes if counts[s]]

    rooms = sorted(room)
    for n in sorted((x for x in hist if x <= capacity // large), reverse=True):
        left = hist[n]
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):                   # new sequences for what fits nowhere
                k = -(-left // (capacity // n))
                room[capacity] = [(used, k)]
                rooms.append(capacity)
                used += k
                i = len(rooms) - 1
            r = rooms[i]
            first, k = room[r].pop()
            if not room[r]:
                del room[r], rooms[i]
            per = min(r // n, left)
            take = min(k, left // per)
            rows.append((n, next_rank[n], take * per, per, first, capacity - r))
            next_rank[n] += take * per
            left -= take * per
            for rest, start, many in ((r - per * n, first, take), (r, first + take, k - take)):
                if rest and many:
                    if rest not in room:
                        insort(rooms, rest)
                        room[rest] = []
                    room[rest].append((start, many))
    return rows, used


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    own = stored(pieces(docs, capacity, id_col, text_col, tokenizer, ranks), "pack-pieces")
    per_part = own.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = stored(per_part.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")),
                      "pack-counts")
    hist = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    rows, _ = plan(hist, capacity)
    rows.sort()
    # the plan is broadcast: its size follows the number of lengths and groups, not of documents
    table = spark.sparkContext.broadcast(np.array(rows or [(0,) * 6], dtype=np.int64))
    release(spark)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = table.value
        keys = p[:, 0] << 44 | p[:, 1]
        for b in batches:
            rank = (b.pop("rank") + b.pop("before")).to_numpy()
            row = p[np.searchsorted(keys, b["length"].to_numpy() << 44 | rank, "right") - 1]
            k = rank - row[:, 1]
            b["sequence_id"] = row[:, 4] + k // row[:, 3]
            b["offset"] = row[:, 5] + k % row[:, 3] * row[:, 0]
            yield b

    # the counts grow with the number of tasks, so they are not broadcast
    joined = own.join(per_part.select("part", "length", "before").hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return joined.mapInPandas(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
