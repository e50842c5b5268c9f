"""Operator 6, n-gram Jaccard join: size bands, hashed bitmap signatures, exact intersections.

A document's set holds its distinct 5-word shingles (64-bit hashes). Two documents link when
100 * |A and B| >= 80 * |A or B|. The join loses no link and never pairs all members of a group:

1. Sets are hashed to a class: documents with equal sets are one class from here on.
2. Order: how many documents hold a shingle is counted over all documents (sorted runs of hashes,
   merged by hash range). The commonest shingles (at most ``MAX_COMMON``) come last in every set;
   any order gives exact results, this one keeps common passages out of the keys.
3. Keys: of sets that link, the first |A| - ceil(0.8 |A|) + 1 shingles in that order share one. A
   key and a size band (band b holds sizes from 1.25^b on; linked sizes are in the same band or in
   neighbouring ones) make a tile. Tiles with members of one class or component only are done.
4. Candidates: members are tried against the least and the greatest member of their tiles; groups
   of near copies become components by that, with at most two trials a member. Then the pairs of
   members of different components that are left in a tile are tried, if their places of the shared
   key leave room for enough common shingles (of sets that link, the first common one does).
5. A trial compares bitmap signatures of parities: each bit that differs is an element that only one
   set has, so their count bounds the overlap from above. What passes is settled by the
   intersection of the sorted arrays of shingles, read once for each pair's group.

Defined results: a text with fewer words than a shingle is one shingle as a whole; null, empty and
wordless texts have no set, link with nothing and are their own component; rows with a null id
keep a null component; rows that share an id are one node; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import free_name, mix, release, ship_code, stored, window_hashes, word_chunks
from feedpulse.llm.components import components

WORDS = 5
COMMON_FROM = 16           # documents that hold a shingle for it to be called common
MAX_COMMON = 1_000_000     # common shingles that are broadcast (13 MB); the rest of them count as rare
HASHES_PER_RANGE = 400_000
SIGNATURE_BITS = 512       # of small sets
SALT_PAIRS = 32            # trials against one set that one task makes


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of a chunk, distinct, sorted by document and shingle."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    own, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(h) >= k:
        start = np.flatnonzero(doc[:len(h) - k + 1] == doc[k - 1:])
        own.append(doc[start])
        sets.append(window_hashes(h, k)[start])
    for i in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence as one
        own.append(np.array([i]))
        sets.append(mix(window_hashes(h[bounds[i]:bounds[i + 1]], int(n[i])) + np.uint64(n[i])))
    own, sets = np.concatenate(own), np.concatenate(sets)
    if len(own) and (np.diff(own) < 0).any():
        order = np.argsort(own, kind="stable")
        own, sets = own[order], sets[order]
    at = np.searchsorted(own, np.arange(len(n) + 1))
    for i in range(len(n)):
        sets[at[i]:at[i + 1]].sort()
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (sets[1:] != sets[:-1])
    return own[new], sets[new]


def _classes(own: np.ndarray, sets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: set size and two sums over its shingles that name the set."""
    size = np.bincount(own, minlength=n)
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        sums = np.zeros(len(sets) + 1, dtype=np.uint64)
        np.cumsum(mix(sets ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return size, *out


class _Chunks:
    """Shingle sets of a task's documents; ``once`` keeps the first document of each class."""

    def __init__(self, once: bool):
        self.once, self.seen = once, set()

    def of(self, texts: list):
        for first, last, _, _, _, h, bounds in word_chunks(texts, lower=True):
            own, sets = shingles(h, bounds)
            size, c1, c2 = _classes(own, sets, last - first)
            if self.once:
                fresh = np.zeros(last - first, dtype=bool)
                for i, c in enumerate(zip(c1.tolist(), c2.tolist())):
                    if size[i] and c not in self.seen:
                        self.seen.add(c)
                        fresh[i] = True
                keep = fresh[own]
                own, sets = own[keep], sets[keep]
            yield first, own, sets, size, c1, c2


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def classes(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, rep (the least id of the documents with the same set; null without a set) and signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].astype("Int64").array
            for first, _, sets, size, c1, c2 in _Chunks(False).of(b["text"].tolist()):
                at = np.concatenate([[0], np.cumsum(size)])
                yield pd.DataFrame({"doc_id": ids[first:first + len(size)], "n_shingles": size, "c1": c1, "c2": c2,
                                    "sign": [signature(sets[at[i]:at[i + 1]]) for i in range(len(size))]})

    own = stored(texts.mapInPandas(run, "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, sign binary"), "jaccard-classes")
    least = stored(own.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "jaccard-least")
    one = own.filter("n_shingles > 0").join(least, ["c1", "c2"]).select("doc_id", "n_shingles", "rep", "sign")
    none = own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("rep"), "sign")
    return stored(one.unionByName(none), "jaccard-documents")


def common_shingles(texts: DataFrame, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, prefixes, levels): the leading ``bits`` + 32 bits of the commonest shingles, sorted, and the
    logarithm of their document counts. Counted over all documents (once for equal sets of a task)."""
    bits = int(min(20, max(5, (total // HASHES_PER_RANGE).bit_length())))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks, held, size = _Chunks(True), [], 0

        def done():
            x = np.sort(np.concatenate(held)) >> np.uint64(32 - bits)
            part = (x >> np.uint64(32)).astype(np.int64)
            low = x.astype(np.uint32)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            return pd.DataFrame({"part": part[at], "run": [r.tobytes() for r in np.split(low, at[1:])]})

        for b in batches:
            for _, _, sets, *_ in chunks.of(b["text"].tolist()):
                held.append(sets)
                size += len(sets)
                if size > 1_000_000:  # a worker holds these some times over while it sorts
                    yield done()
                    held, size = [], 0
        if size:
            yield done()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        x, n = np.unique(np.concatenate([np.frombuffer(r, np.uint32) for r in f["run"]]), return_counts=True)
        x, n = x[n >= COMMON_FROM], n[n >= COMMON_FROM]
        level = np.log2(n).astype(np.int32)
        out = pd.DataFrame({"part": f["part"].iloc[0], "level": level, "low": x.astype(np.int64)})
        return out.groupby(["part", "level"], as_index=False).agg(
            n=("low", "size"), run=("low", lambda s: s.to_numpy().astype(np.uint32).tobytes()))

    spark = texts.sparkSession
    got = texts.select("text").mapInPandas(runs, "part bigint, run binary").groupBy("part").applyInPandas(
        merge, "part bigint, level int, n bigint, run binary")
    got = stored(got, "jaccard-common")
    release(spark)
    least, held = 99, 0
    for r in sorted(got.groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["level"]):
        held += r["n"]
        if held > MAX_COMMON:
            break
        least = r["level"]
    rows = got.filter(F.col("level") >= least).collect()  # at most MAX_COMMON numbers
    x = [np.uint64(r["part"]) << np.uint64(32) | np.frombuffer(r["run"], np.uint32).astype(np.uint64) for r in rows]
    x = np.concatenate([np.zeros(0, np.uint64), *x])
    level = np.repeat(np.array([r["level"] for r in rows], dtype=np.int8), [r["n"] for r in rows])
    order = np.argsort(x)
    return bits, x[order], level[order]


def _needed(n: np.ndarray) -> np.ndarray:
    """Shingles of a prefix that shares one with every set that links."""
    return n - (4 * n + 4) // 5 + 1


def own_group(task: int, flush: int) -> int:
    """A group number below 0 that no other flush of any task has; a task that is run again has the same ones."""
    return -1 - (task << 31 | flush)


def tiles(texts: DataFrame, common: tuple) -> DataFrame:
    """(key, node, place in the set's order) for the prefix shingles that several sets share, once for equal sets of a task.

    A task sends its keys as sorted runs, one for each hash range (32 bits a key, as further bits are
    the range's, and the ids); a range's runs are merged in memory, where keys of a single node
    end. The number of ranges follows the number of shingles, and a key's nodes are bounded because the
    common shingles, which are shared for sure, are sent on by themselves without being gathered."""
    bits, *arrays = common
    spark = texts.sparkSession
    table = spark.sparkContext.broadcast(arrays)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks, (prefixes, levels) = _Chunks(True), table.value
        held, size, flushes = [], 0, 0

        def done():
            nonlocal held, size, flushes
            x, node, rank, place = (np.concatenate(c) for c in zip(*held))
            held, size, flushes = [], 0, flushes + 1
            part = (x >> np.uint64(64 - bits)).astype(np.int64)
            part[rank > 0] = own_group(TaskContext.get().partitionId(), flushes)
            low = (x >> np.uint64(32 - bits)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            part, low, node, place = part[order], low[order], node[order], place[order]
            high = (x >> np.uint64(64 - bits)).astype(np.int32)[order]
            at = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            ends = [*at[1:], len(part)]
            return pd.DataFrame({
                "part": part[at], "low": [low[i:j].tobytes() for i, j in zip(at, ends)],
                "high": [high[i:j].tobytes() if p < 0 else b"" for p, i, j in zip(part[at], at, ends)],
                "base": [int(node[i:j].min()) for i, j in zip(at, ends)],
                "node": [_narrow(node[i:j]) for i, j in zip(at, ends)],
                "place": [_narrow(place[i:j], 0) for i, j in zip(at, ends)]})

        for b in batches:
            known = b["doc_id"].notna().to_numpy()
            ids = b["doc_id"].fillna(0).to_numpy(dtype=np.int64)
            texts_ = [t if k else None for t, k in zip(b["text"], known)]
            for first, own, sets, n, _, _ in chunks.of(texts_):
                rank = np.zeros(len(sets), dtype=np.int64)
                if len(prefixes) and len(sets):
                    x = sets >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(prefixes, x), len(prefixes) - 1)
                    rank = np.where(prefixes[at] == x, levels[at], 0).astype(np.int64)
                    order = np.argsort(own * 128 + rank, kind="stable")  # sorted by document and shingle before
                    own, sets, rank = own[order], sets[order], rank[order]
                begin = np.flatnonzero(np.diff(own, prepend=-1))
                place = np.arange(len(own)) - np.repeat(begin, np.diff(begin, append=len(own)))
                keep = place < _needed(n[own])
                held.append((sets[keep], ids[first + own[keep]], rank[keep], place[keep]))
                size += int(keep.sum())
                if size > 1_000_000:
                    yield done()
        if size:
            yield done()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(r, np.uint32) for r in f["low"]])
        node = np.concatenate([_wide(r, base, len(x) // 4) for r, base, x in zip(f["node"], f["base"], f["low"])])
        place = np.concatenate([_wide(r, 0, len(x) // 4) for r, x in zip(f["place"], f["low"])])
        part = int(f["part"].iloc[0])
        if part < 0:
            key = np.frombuffer(b"".join(f["high"]), np.int32).astype(np.int64) << 32 | low
            return pd.DataFrame({"key": key, "node": node, "place": place})
        order = np.lexsort((node, low))
        low, node, place = low[order], node[order], place[order]
        begin = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        shared = node[np.append(begin[1:], len(low)) - 1] != node[begin] if len(low) else np.zeros(0, bool)
        keep = np.repeat(shared, np.diff(begin, append=len(low)))
        return pd.DataFrame({"key": np.int64(part) << 32 | low[keep].astype(np.int64), "node": node[keep], "place": place[keep]})

    got = texts.mapInPandas(runs, "part bigint, low binary, high binary, base bigint, node binary, place binary")
    return got.groupBy("part").applyInPandas(merge, "key bigint, node bigint, place int")


def _narrow(x: np.ndarray, low: int | None = None) -> bytes:
    """Numbers as 16- or 32-bit distances from the least, or whole if they lie too far apart."""
    low = x.min() if low is None else low
    span = float(x.max()) - float(low)
    return x.tobytes() if span >= 2**32 else (x - low).astype(np.uint16 if span < 2**16 else np.uint32).tobytes()


def _wide(data: bytes, base: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // max(n, 1)}").astype(np.int64) + base if len(data) < 8 * n else np.frombuffer(data, np.int64)


def signature(sets: np.ndarray) -> bytes:
    """A bit for each value of the hashes' low bits: whether an odd number of shingles has it. The
    number of bits is a power of two and follows the set's size, so signatures of long documents tell as much."""
    bits = max(SIGNATURE_BITS, 1 << max(len(sets) - 1, 0).bit_length())
    odd = np.bincount((sets >> np.uint64(7)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Number of differing bits of each two signatures, the longer one folded to the shorter."""
    out = np.zeros(len(a), dtype=np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
    for n, m in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (n, m)).all(axis=1))
        x, y = (np.frombuffer(b"".join([s[i] for i in at]), np.uint64).reshape(len(at), -1) for s in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
        while y.shape[1] > x.shape[1]:
            y = y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def candidate_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and sorted shingles of the given documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].astype("Int64").array
            for first, _, sets, size, _, _ in _Chunks(False).of(b["text"].tolist()):
                at = np.concatenate([[0], np.cumsum(size)])
                yield pd.DataFrame({"node": ids[first:first + len(size)],
                                    "items": [sets[at[i]:at[i + 1]].tobytes() for i in range(len(size))]})

    own = texts.join(nodes, texts["doc_id"] == nodes["node"], "left_semi")
    return own.mapInPandas(run, "node bigint, items binary")


def _bounded(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    s = own.filter("doc_id = rep").select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "sign")
    for end in ("a", "b"):
        pairs = pairs.join(s.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("sign").alias(f"s{end}")), end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if not len(f):
                continue
            na, nb = f["na"].to_numpy().astype(np.int64), f["nb"].to_numpy().astype(np.int64)
            apart = differing(f["sa"].tolist(), f["sb"].tolist())
            most = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
            yield f.loc[100 * most >= 80 * (na + nb - most), ["a", "b"]]

    return pairs.mapInPandas(run, "a bigint, b bigint")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by exact intersection: b's set travels once a pair, a's once for SALT_PAIRS pairs."""
    each = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")), "jaccard-trials")
    salts = F.ceil(F.col("m") / SALT_PAIRS).cast("int")
    left = (each.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
            .select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "ia"))
    right = (pairs.join(each, "a").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
             .join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b").select("a", "salt", "b", "ib"))

    def settle(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, ia in zip(one["a"], one["ia"]):
            x = np.frombuffer(ia, np.uint64)
            for b, items in zip(many["b"], many["ib"]):
                y = np.frombuffer(items, np.uint64)
                if len(x) and len(y):
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * both >= 80 * (len(x) + len(y) - both):
                        out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.groupBy("a", "salt").cogroup(right.groupBy("a", "salt")).applyInPandas(settle, "a bigint, b bigint")


def _ends(members: DataFrame) -> DataFrame:
    """Trials (a, b) of every member against the least, and the greatest, end of all its tiles that hold several components."""
    end = stored(members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min("comp").alias("lo"),
                                            F.max("comp").alias("hi")).filter("lo < hi").select("key", "first", "last"), "jaccard-ends")
    best = members.join(end, "key").groupBy("node").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return best.select(F.explode(F.array("first", "last")).alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()


def _rest(members: DataFrame) -> DataFrame:
    """Trials (a, b) of all members of a tile that are in different components, by size bands."""
    mixed = stored(members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                   .filter("lo < hi").select("key"), "jaccard-mixed")
    left = stored(members.join(mixed, "key", "left_semi"), "jaccard-rest")
    # a member meets the members of its own band and of the next smaller one
    band = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")
    x = left.select("key", F.explode(F.array(band - 1, band)).alias("band"), F.col("node").alias("a"), F.col("n").alias("na"),
                    F.col("place").alias("pa"), F.col("comp").alias("ca"), band.alias("own"))
    y = left.select(F.col("key").alias("kb"), band.alias("bb"), F.col("node").alias("b"), F.col("n").alias("nb"),
                    F.col("place").alias("pb"), F.col("comp").alias("cb"))
    fits = ((F.col("ca") != F.col("cb")) & (4 * F.greatest("na", "nb") <= 5 * F.least("na", "nb"))
            & ((F.col("own") > F.col("band")) | (F.col("a") < F.col("b")))
            # if this is their first common shingle, no more can be common than one side has from it on
            & (9 * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= 4 * (F.col("na") + F.col("nb"))))
    met = x.join(y, (F.col("key") == F.col("kb")) & (F.col("band") == F.col("bb")) & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every document."""
    spark = docs.sparkSession
    ship_code(spark)
    texts = _texts(docs, id_col, text_col)
    own = classes(texts)
    total = own.agg(F.sum("n_shingles")).first()[0] or 0
    shared = stored(tiles(texts, common_shingles(texts, total)), "jaccard-shared")
    release(spark)
    # nodes become their classes' representatives, with the size of the set
    reps = own.filter("rep is not null").select(F.col("doc_id").alias("node"), "rep", F.col("n_shingles").alias("n")).distinct()
    placed = stored(shared.join(reps, "node").select("key", F.col("rep").alias("node"), "n", "place").distinct(), "jaccard-tiles")
    release(spark)
    links = roots = sets = None
    for trials in (_ends, _rest):
        members = placed.withColumn("comp", F.col("node")) if roots is None else (
            placed.join(roots, "node", "left").select("key", "node", "n", "place", F.coalesce("root", "node").alias("comp")))
        near = stored(_bounded(trials(members), own).distinct(), "jaccard-near")
        release(spark)
        # the texts are read once more for the sets of those whose signatures are near, as far as they are not there
        nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if sets is not None:
            nodes = nodes.join(sets.select("node"), "node", "left_anti")
        more = stored(candidate_sets(texts, stored(nodes, "jaccard-nodes")), "jaccard-sets")
        sets = more if sets is None else sets.unionByName(more)
        release(spark)
        found = stored(_linked(near, sets), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        release(spark)
    out = own.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component (and all with a null id), with their own
    columns. Rows that share an id are documents of their own: of those in one component one stays."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("i")).filter("i is not null")
    if ids.groupBy("i").count().filter("count > 1").limit(1).count():
        return _keep_rows(docs, id_col, text_col)
    found = stored(join(docs, id_col, text_col), "jaccard-components")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(free_name(docs.columns, "gone_id")))
    return docs.join(gone, F.col(id_col).cast("bigint") == gone[gone.columns[0]], "left_anti")


def _keep_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keep_documents`` where ids repeat: the join takes a number per row, stored so that it does not change."""
    row = free_name(docs.columns, "row_id")
    number = F.when(F.col(id_col).cast("bigint").isNotNull(), F.monotonically_increasing_id())
    rows = stored(docs.withColumn(row, number), "jaccard-rows")
    found = stored(join(rows, row, text_col), "jaccard-components")
    linked = found.filter("component_id is not null").select(F.col("doc_id").alias("node"), "component_id")
    keys = rows.select(F.col(row).alias("n"), F.col(id_col).cast("bigint").alias("i"), F.xxhash64(F.col(text_col)).alias("th"))
    groups = linked.join(keys, F.col("node") == F.col("n"))
    first = groups.groupBy("component_id").agg(F.min(F.struct("i", "th", "n")).alias("first")).select(
        F.col("component_id").alias("c"), F.col("first.n").alias("kept"))
    gone = stored(linked.join(first, (F.col("component_id") == F.col("c")) & (F.col("node") != F.col("kept"))).select("node"), "jaccard-gone")
    gone = gone.select(F.col("node").alias(free_name(rows.columns, "gone_id")))
    return rows.join(gone, F.col(row) == gone[gone.columns[0]], "left_anti").drop(row)
