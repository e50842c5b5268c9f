"""Operator 9, substring dedup: prefix-partitioned suffix trees.

Two suffixes (a document from one of its words on) that share 35 words meet below a node of depth 35 of
the corpus's suffix tree, so the repeated windows are the leaves below the nodes of at least that depth
that have two leaves. The tree is cut by prefixes of variable length, and only where suffixes share them:

* Prefixes of 8 words are counted at one suffix in about 14: of the 28 places where 8 words fit into a
  window, the one with the least hash represents it (equal windows agree on it). A prefix that is found once
  ends there, which drops the unrepeated bulk of the corpus; a collision of hashes only adds work.
* A shared prefix's suffixes travel as slices: the words of all windows that the place represents, up to
  62. Prefixes are dealt into groups by their counts, so that a group fits into a task's memory.
* A task builds the subtrees of its group: it numbers the words, sorts the suffixes that begin a window by their words,
  and compares neighbours. Neighbours with 35 common words lie below one deep node; all below
  nodes with two leaves are repeated. Words are compared as they are, so nothing is removed on equal hashes.
* A prefix with more than ``GROUP_ROWS`` suffixes is lengthened to all 35 words of each of its windows. Equal
  slices of it are counted before the shuffle and sent once; a window found twice is a deep node.

Neighbouring windows merge into maximal repeats when a document's words are marked. Every step works on
counts or on groups of bounded size, however many documents share a passage.

Texts and prefixes that meet nothing stay where they are: before each join a bitmap of the other side's keys
tells them apart, and only what may meet something is shuffled (equality is still decided by the join).

Defined results: a null or empty text has no words and stays empty; null and repeated ids and
repeated rows are documents of their own (a repeated row repeats all its windows); an empty table
gives no rows; other columns are ignored, or carried along by ``dedup_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import free_name, release, ship_code, stored, window_hashes, word_chunks

WINDOW = 35
PREFIX = 8
GROUP_ROWS = 32_000   # slices of a group; a prefix with more is lengthened
SORT_ROWS = 8_000     # slices that are sorted at once; more only where one prefix has them
SMALL_NODES = 20_000  # lengthened slices up to which their table is broadcast
FILTER_BITS = 16      # bits of a bitmap for each of its keys, of which one is set
FILTER_MOST = 1 << 27  # bits of a bitmap at most (16 MB); with more keys it lets more rows through, never fewer


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbours (the first of equals)."""
    at, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        span += step
    return at


def _windows(h: np.ndarray, bounds: np.ndarray, window: int, prefix: int):
    """Of a chunk: window starts (inside one document), the place of each one's representative."""
    if len(h) < window:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint64)
    g = window_hashes(h, prefix)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(doc[:len(h) - window + 1] == doc[window - 1:])
    return start, least_places(g, window - prefix + 1)[start], g


def _rows(batch: pd.DataFrame, cols: dict) -> pd.DataFrame:
    """A frame of the batch's document keys at ``cols['row']`` and the other columns."""
    row = cols.pop("row")
    return pd.DataFrame({"doc_id": batch["doc_id"].array.take(row), "th": batch["th"].to_numpy()[row], **cols})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text: the pair names a document, as ids may repeat."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def split_by(df: DataFrame, on: list, keys: DataFrame, key_cols: list, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``on`` may be one of the ``n`` rows of ``keys``, and the rest: all that are one and few others
    are among the first. Hashes of the keys are marked in a bitmap of bounded size, which is broadcast."""
    size = min(FILTER_MOST, max(1 << 20, FILTER_BITS * n))
    # the functions on bitmaps number bits from 1
    marked = keys.select((F.pmod(F.xxhash64(*key_cols), F.lit(size)) + 1).alias("bit"))
    p, q, bits = (free_name(df.columns, x) for x in ("bit", "bucket", "bits"))
    bitmap = stored(marked.groupBy(F.bitmap_bucket_number("bit").alias(q))
                    .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(bits)), "suffix-bitmap")
    bit = F.pmod(F.xxhash64(*on), F.lit(size)) + 1
    joined = (df.withColumns({p: F.bitmap_bit_position(bit), q: F.bitmap_bucket_number(bit)})
              .join(F.broadcast(bitmap), q, "left"))
    byte = F.conv(F.hex(F.substring(bits, (F.col(p) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    may = F.coalesce(F.getbit(byte, (F.col(p) % 8).cast("int")) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return joined.filter(may).select(*own), joined.filter(~may).select(*own)


def _with_starts(docs: DataFrame, starts: DataFrame, doc_id, th, name: str) -> DataFrame:
    """``docs`` with their ``starts`` as column ``name`` (null: none); documents that cannot have any are not shuffled."""
    d, t = (free_name([*docs.columns, name], x) for x in ("d", "t"))
    some, rest = split_by(docs, [doc_id, th], starts, ["doc_id", "th"], starts.count())
    own = [F.col(f"`{c}`") for c in docs.columns]
    right = starts.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("starts").alias(name))
    met = some.join(right, doc_id.eqNullSafe(F.col(d)) & (th == F.col(t)), "left").select(*own, F.col(name))
    return met.unionByName(rest.withColumn(name, F.lit(None).cast(right.schema[name].dataType)))


def _nullable(batches):
    for b in batches:
        b["doc_id"] = b["doc_id"].astype("Int64")
        yield b


def sort_suffixes(slices: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subtrees of a group of slices: (slice, word at which the suffix begins, whether a neighbour shares
    ``window`` words) of every suffix with that many words, in the order of the slices."""
    words = [bytes(x).split() for x in slices]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ids = pd.factorize(np.array([x for w in words for x in w] + [None], dtype=object)[:-1])[0].astype(">u4")
    begin = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.maximum(sizes - window + 1, 0)
    own = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(own):
        return own, first, np.zeros(0, dtype=bool)
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[begin[own] + first]
    # the words' numbers as bytes sort as the words; a last byte that is no zero keeps numpy from cutting zeros off
    keys = np.ones((len(rows), 4 * window + 1), dtype=np.uint8)
    keys[:, :-1] = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    order = np.argsort(keys.view(f"S{4 * window + 1}").ravel(), kind="stable")
    deep = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)  # a node of depth ``window`` or more above both
    shared = np.zeros(len(rows), dtype=bool)
    shared[order[1:]] |= deep
    shared[order[:-1]] |= deep
    return own, first, shared


def _runs(own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring numbers ``at`` of one owner: (owner, first, count)."""
    edge = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    return own[edge], at[edge], np.diff(np.append(edge, len(own)))


def repeats_of(slices: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows of a group's slices: (slice, first, count). Equal slices are one leaf set of the trees."""
    which, different = pd.factorize(np.array([*slices, None], dtype=object)[:-1])
    own, first, shared = sort_suffixes(list(different), window)
    shared |= np.bincount(which, minlength=len(different))[own] > 1
    of, first, count = _runs(own[shared], first[shared])
    each = np.bincount(of, minlength=len(different))  # runs of a different slice, which lie together
    begin, n = np.cumsum(each) - each, each[which]
    row = np.repeat(np.arange(len(which)), n)
    at = begin[which[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, first[at], count[at]


def repeated_starts(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, th and ``starts``: runs (first, count) of the first words of the document's repeated windows (only
    documents that have some)."""
    spark = docs.sparkSession
    ship_code(spark)
    keyed = _keyed(docs, id_col, text_col)

    def represent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _nullable(batches):
            for first, _, _, _, _, h, bounds in word_chunks(b["text"].tolist()):
                _, rep, g = _windows(h, bounds, window, prefix)
                rep = np.unique(rep)
                own = np.searchsorted(bounds, rep, "right") - 1
                yield _rows(b, {"row": first + own, "key": g[rep].view(np.int64), "place": (rep - bounds[own]).astype(np.int32)})

    sparse = stored(keyed.mapInPandas(represent, "doc_id bigint, th bigint, key bigint, place int"), "suffix-prefixes")
    shared = stored(sparse.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-shared")
    release(spark)
    prefixes, members, most = shared.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    groups, hot = max(1, -(-(members or 0) // GROUP_ROWS)), (most or 0) > GROUP_ROWS
    places = stored(split_by(sparse, ["key"], shared, ["key"], prefixes)[0].join(shared, "key").groupBy("doc_id", "th")
                    .agg(F.collect_set(F.struct("place", (F.col("n") > GROUP_ROWS).alias("hot"))).alias("places"))
                    # a short number for the document: the slices, of which there are most, carry it
                    .withColumn("uid", F.monotonically_increasing_id()), "suffix-places")
    release(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per shared prefix: the words of the windows that it represents, and the first one's place."""
        for b in batches:
            for first, last, data, begin, end, h, bounds in word_chunks(b["text"].tolist()):
                start, rep, g = _windows(h, bounds, window, prefix)
                wanted = np.zeros(len(h) + 1, dtype=np.int8)
                for i in range(first, last):
                    for p in b["places"].iloc[i]:
                        wanted[bounds[i - first] + p["place"]] = 1 + p["hot"]
                keep = wanted[rep] > 0
                start, rep = start[keep], rep[keep]
                at = np.flatnonzero(np.diff(rep, prepend=-1))  # neighbours with one representative
                final = np.append(at[1:], len(rep)) - 1
                own = np.searchsorted(bounds, start[at], "right") - 1
                lo, hi = begin[start[at]], end[start[final] + window - 1] if len(at) else begin[:0]
                yield pd.DataFrame({"uid": b["uid"].to_numpy()[first + own], "place": (start[at] - bounds[own]).astype(np.int32),
                                    "key": g[rep[at]].view(np.int64) if len(at) else np.zeros(0, np.int64), "hot": wanted[rep[at]] == 2,
                                    "slice": [data[i:j] for i, j in zip(lo, hi)]})

    some = split_by(keyed, ["doc_id", "th"], places, ["doc_id", "th"], places.count())[0]
    some = some.join(places.withColumnsRenamed({"doc_id": "d", "th": "t"}),
                     some["doc_id"].eqNullSafe(F.col("d")) & (some["th"] == F.col("t"))).select("uid", "text", "places")
    slices = some.mapInPandas(cut, "uid bigint, place int, key bigint, hot boolean, slice binary")
    slices = stored(slices, "suffix-slices") if hot else slices

    def subtrees(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key", kind="stable")
        edges = np.flatnonzero(np.diff(f["key"].to_numpy(), append=f["key"].iloc[-1] + 1)) + 1  # prefixes end here
        out, at = [], 0
        while at < len(f):
            to = edges[max(np.searchsorted(edges, at + SORT_ROWS, "right") - 1, np.searchsorted(edges, at, "right"))]
            row, first, count = repeats_of(f["slice"].iloc[at:to].tolist(), window)
            out.append(pd.DataFrame({"uid": f["uid"].to_numpy()[at + row], "first": (f["place"].to_numpy()[at + row] + first).astype(np.int32),
                                     "count": count.astype(np.int32)}))
            at = to
        return pd.concat(out)

    group = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g")
    found = (slices.filter("not hot").select("uid", "place", "key", "slice", group).groupBy("g")
             .applyInPandas(subtrees, "uid bigint, first int, count int"))
    if hot:
        found = found.unionByName(_lengthened(slices.filter("hot"), window))
    found = stored(found, "suffix-found")
    release(spark)
    starts = found.groupBy("uid").agg(F.collect_list(F.struct("first", "count")).alias("starts"))
    starts = stored(starts.join(places.select("uid", "doc_id", "th"), "uid").select("doc_id", "th", "starts"), "suffix-starts")
    release(spark)
    return starts


def _lengthened(slices: DataFrame, window: int) -> DataFrame:
    """Repeated windows (uid, first, count) of prefixes with too many suffixes for a group: the prefix is
    lengthened to the ``window`` words of each window of each different slice, and counted."""
    different = stored(slices.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("sid", F.monotonically_increasing_id()), "suffix-different")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, n, text in zip(b["sid"], b["n"], b["slice"]):
                w = bytes(text).split()
                out += [(sid, n, i, b" ".join(w[i:i + window])) for i in range(len(w) - window + 1)]
            yield pd.DataFrame(out, columns=["sid", "n", "i", "words"])

    each = stored(different.select("sid", "n", "slice").mapInPandas(windows, "sid bigint, n bigint, i int, words binary"), "suffix-long")
    deep = stored(each.groupBy("words").agg(F.sum("n").alias("leaves")).filter("leaves > 1").select("words"), "suffix-deep")
    at = each.join(deep, "words", "left_semi").groupBy("sid").agg(F.sort_array(F.collect_list("i")).alias("at"))
    known = stored(different.join(at, "sid").select("slice", "at"), "suffix-known")
    known = F.broadcast(known) if known.count() <= SMALL_NODES else known
    return slices.join(known, "slice").select("uid", F.explode(F.transform("at", lambda i: F.col("place") + i)).alias("first"),
                                              F.lit(1).alias("count"))


def covered(n: int, starts, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins in one of the runs ``starts`` of (first, count)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    if starts is not None and len(starts):
        first = np.array([s["first"] for s in starts], dtype=np.int64)
        count = np.array([s["count"] for s in starts], dtype=np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(texts: list, starts: list, window: int) -> Iterator[tuple[int, int, bytes]]:
    """Per text: words, removed words, and the kept words joined by one space."""
    for t, s in zip(texts, starts):
        words = [] if t is None else t.encode("utf-8", "surrogatepass").split()
        gone = covered(len(words), s, window)
        removed = int(gone.sum())
        yield len(words), removed, b" ".join([w for w, g in zip(words, gone) if not g] if removed else words)


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every document."""
    keyed = _keyed(docs, id_col, text_col)
    starts = repeated_starts(docs, window, prefix, id_col, text_col)
    joined = _with_starts(keyed, starts, F.col("doc_id"), F.col("th"), "starts")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _nullable(batches):
            got = list(_kept(b["text"].tolist(), b["starts"].tolist(), window))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": [x[0] for x in got], "n_removed": [x[1] for x in got],
                                "kept": [x[2] for x in got]})

    return joined.select("doc_id", "text", "starts").mapInPandas(
        remove, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def digest(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """The result of ``dedup`` with the kept text's SHA-256 in its place."""
    return dedup(docs, window, prefix).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def dedup_documents(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id",
                    text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with repeated windows removed from their texts (texts without any stay as they
    are) and their own columns; ``chars_col`` follows the text where it exists."""
    starts = repeated_starts(docs, window, prefix, id_col, text_col)
    s, k = (free_name(docs.columns, x) for x in ("starts", "kept_text"))
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = _with_starts(docs, starts, F.col(id_col).cast("bigint"), th, s)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([x[2].decode("utf-8", "surrogatepass") for x in _kept(texts.tolist(), places.tolist(), window)])

    out = joined.withColumn(k, F.when(F.col(s).isNull(), F.col(text_col)).otherwise(kept(F.col(text_col), F.col(s))))
    value = {text_col: F.col(k)}
    if chars_col in docs.columns:
        value[chars_col] = F.length(k).cast(docs.schema[chars_col].dataType)
    return out.select(*[value.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
