"""Operator 13: the trie of rebuilt conversations' prefixes, by composable fingerprints.

A rebuilt conversation is the head of another (its base) followed by its own later turns. ``trie``
returns one row for every distinct prefix of the rebuilt conversations, with its members, its subtree's
leaves and the tokens (bytes) that sharing saves.

Texts are never rebuilt. All turns are numbered once, in the order (conversation, turn), and a running
sum of ``key(turn) * x**number`` modulo two primes is kept at each. Such sums are a monoid: the sum over
any run of turns is a difference of two running sums, and a power of x shifts it to another place. So
the fingerprint of a rebuilt prefix is the base's head product plus the shifted product of the own
suffix, both taken from stored numbers. A path row holds a conversation, a depth, the fingerprint and
the stored turn it refers to.

Equal fingerprints are verified, not believed: turns with equal keys must have equal role and text, and
all path rows of a (depth, fingerprint) group must refer to turns of one key and have one fingerprint of
the prefix before; by induction over the depth a group then is exactly one sequence of turns. If any check
fails, everything is done again with other keys and another x.

Subtree sums need no walk over levels. A node belongs to its smallest member, the nodes of one owner
form a chain of depths down to the conversation's end, and a node's subtree is the rest of its owner's
chain plus the whole chains of its other members: a suffix sum by chain, and one aggregate over path
rows, of which there are as many as rebuilt turns.

A conversation may hold a third of all turns, and a turn may begin a third of all conversations: joins by
conversation are split into blocks of turn numbers, sums by prefix are aggregated before the shuffle,
chains are summed in blocks, and the ids that end at a node are joined to strings range by range before
they meet, as a stream, in one hash.

Defined results: rows without a conv_id take no part; null turns come first; turns of equal number are
ordered by role, then text (by its first 64 characters, then by its key); null role or text is empty; repeated rows
are turns of their own; an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.llm.common import ship_code, stored
from feedpulse.llm.order import ranked

PRIMES = (2147483647, 2147483629)  # products of residues fit into 64 bits
BLOCK = 4096  # turn numbers or depths that meet in one task
HEAD = 8  # longest head of a base
STRIDE = 5
ATTEMPTS = 8
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _power(x: int, exponent: Column, p: int) -> Column:
    """x ** exponent modulo the prime p, by the exponent's bits."""
    e = F.pmod(exponent, F.lit(p - 1))  # x ** (p - 1) is 1, so negative exponents are powers too
    out, square = F.lit(1).cast("long"), x
    for bit in range(31):
        out = out * F.when(F.shiftright(e, bit).bitwiseAND(1) == 1, F.lit(square)).otherwise(F.lit(1)) % p
        square = square * square % p
    return out


def _packed(f1: Column, f2: Column) -> Column:
    return f1 * (1 << 31) + f2


def head_length(conv: Column) -> Column:
    """How many turns of its base a conversation begins with."""
    return (F.crc32(conv.cast("string")) % (HEAD + 1)).cast("long")


def base_of(conv: Column) -> Column:
    return conv - conv % STRIDE


def _numbered(turns: DataFrame, seed: int) -> tuple[DataFrame, list[int]]:
    """All turns (c, r, tk, bytes, and per prime the running sum g and its last term t), and the x of each prime."""
    xs = np.random.default_rng(seed).integers(1 << 20, 1 << 30, len(PRIMES))
    rows = ranked(turns, [F.col("c"), F.col("turn"), F.col("role"), F.left("text", F.lit(64)), F.col("tk")],
                  "trie-turns", keep=["c", "tk", "bytes"])
    block = F.floor(F.col("r") / F.lit(BLOCK)).alias("block")
    rows = rows.select("*", block, *[
        (F.pmod(F.xxhash64("tk", F.lit(i)), F.lit(p)) * _power(int(xs[i]), F.col("r"), p) % p).alias(f"t{i}") for i, p in enumerate(PRIMES)])
    rows = stored(rows, "trie-terms")
    # sums by block, then by range of blocks, then all: no window sees more than BLOCK rows or blocks
    sums = rows.groupBy("block").agg(*[(F.sum(f"t{i}") % p).alias(f"s{i}") for i, p in enumerate(PRIMES)])
    sums = sums.withColumn("span", F.floor(F.col("block") / F.lit(BLOCK)))
    spans = sums.groupBy("span").agg(*[(F.sum(f"s{i}") % p).alias(f"u{i}") for i, p in enumerate(PRIMES)])
    before = Window.unboundedPreceding, -1
    by_span, in_span = Window.orderBy("span").rowsBetween(*before), Window.partitionBy("span").orderBy("block").rowsBetween(*before)
    spans = spans.select("span", *[F.coalesce(F.sum(f"u{i}").over(by_span), F.lit(0)).alias(f"u{i}") for i in range(len(PRIMES))])
    sums = sums.join(spans, "span").select("block", *[
        ((F.col(f"u{i}") + F.coalesce(F.sum(f"s{i}").over(in_span), F.lit(0))) % p).alias(f"s{i}") for i, p in enumerate(PRIMES)])
    here = Window.partitionBy("block").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, "block").select("c", "r", "block", "tk", "bytes", "t0", "t1", *[
        ((F.col(f"s{i}") + F.sum(f"t{i}").over(here)) % p).alias(f"g{i}") for i, p in enumerate(PRIMES)])
    return stored(rows, "trie-numbered"), [int(x) for x in xs]


def _by_block(table: DataFrame, first: Column, last: Column, *keep) -> DataFrame:
    """A row of ``table`` for every block from ``first`` to ``last`` (none if there are none)."""
    a, b = F.floor(first / F.lit(BLOCK)), F.floor(last / F.lit(BLOCK))
    return table.where(first <= last).select(*keep, F.explode(F.sequence(a, b)).alias("block"))


def _plans(rows: DataFrame, xs: list[int]) -> DataFrame:
    """A row for every conversation: how it is rebuilt, and the numbers its fingerprints are made of."""
    n = range(len(PRIMES))
    convs = rows.groupBy("c").agg(F.min("r").alias("start"), F.count(F.lit(1)).alias("len"), *[
        F.pmod(F.min_by(F.col(f"g{i}") - F.col(f"t{i}"), "r"), F.lit(p)).alias(f"b{i}") for i, p in enumerate(PRIMES)], *[
        F.max_by(f"g{i}", "r").alias(f"e{i}") for i in n])
    convs = stored(convs, "trie-conversations")
    near = _by_block(convs, F.col("start"), F.least(F.col("start") + HEAD, F.col("start") + F.col("len")) - 1,
                     F.col("c").alias("of"), "start", "b0", "b1")
    heads = rows.join(near, (F.col("c") == F.col("of")) & (rows["block"] == near["block"])).where(F.col("r") - F.col("start") < HEAD)
    heads = heads.select("c", F.struct(
        (F.col("r") - F.col("start") + 1).alias("q"), "r", "tk", "bytes", "g0", "g1", *[
            (F.pmod(F.col(f"g{i}") - F.col(f"b{i}"), F.lit(p)) * _power(xs[i], 1 - F.col("start"), p) % p).alias(f"f{i}")
            for i, p in enumerate(PRIMES)]).alias("turn"))
    heads = heads.groupBy("c").agg(F.sort_array(F.collect_list("turn")).alias("head"))  # at most HEAD each
    convs = convs.join(heads, "c").withColumn("h", head_length(F.col("c")))
    base = heads.select(F.col("c").alias("base"), F.col("head").alias("base_head"))
    plan = convs.join(base, base_of(F.col("c")) == F.col("base"), "left")
    plan = plan.withColumn("base_head", F.slice(F.coalesce("base_head", F.filter("head", lambda t: F.lit(False))), F.lit(1), F.col("h").cast("int")))
    plan = plan.withColumn("m", F.size("base_head").cast("long")).withColumn("own", F.greatest(F.col("len") - F.col("h"), F.lit(0)))
    last = F.get("base_head", F.col("m").cast("int") - 1)
    at_h = F.get("head", F.col("h").cast("int") - 1)  # the last own turn that is left out
    plan = plan.select("c", "start", "len", "h", "m", "own", "base_head", "e0", "e1", *[
        F.coalesce(last[f"f{i}"], F.lit(0)).alias(f"f{i}") for i in n], *[
        F.when(F.col("h") == 0, F.col(f"b{i}")).otherwise(at_h[f"g{i}"]).alias(f"h{i}") for i in n], *[
        _power(xs[i], F.col("m") - F.col("h") - F.col("start") + 1, p).alias(f"k{i}") for i, p in enumerate(PRIMES)])
    return stored(plan, "trie-plans")


def _composed(total: list[Column]) -> Column:
    """Fingerprint of a base's head and the own turns up to the running sums ``total``."""
    return _packed(*[(F.col(f"f{i}") + F.pmod(total[i] - F.col(f"h{i}"), F.lit(p)) * F.col(f"k{i}")) % p for i, p in enumerate(PRIMES)])


def _paths(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for every prefix of every rebuilt conversation: (c, depth, fp, pfp, tk, bytes, ref)."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = plan.select("c", zero.alias("depth"), zero.alias("fp"), none.alias("pfp"), none.alias("tk"), zero.alias("bytes"), none.alias("ref"))
    heads = plan.select("c", "base_head", F.posexplode("base_head").alias("i", "t"))
    before = F.get("base_head", F.col("i") - 1)
    heads = heads.select("c", (F.col("i") + 1).cast("long").alias("depth"), _packed(F.col("t.f0"), F.col("t.f1")).alias("fp"),
                         F.coalesce(_packed(before["f0"], before["f1"]), zero).alias("pfp"), "t.tk", "t.bytes", F.col("t.r").alias("ref"))
    used = _by_block(plan.withColumnRenamed("c", "of"), F.col("start") + F.col("h"), F.col("start") + F.col("len") - 1,
                     "of", "start", "h", "m", "f0", "f1", "h0", "h1", "k0", "k1")
    own = rows.join(used, (F.col("c") == F.col("of")) & (rows["block"] == used["block"])).where(F.col("r") >= F.col("start") + F.col("h"))
    own = own.select("c", (F.col("m") + F.col("r") - F.col("start") + 1 - F.col("h")).alias("depth"),
                     _composed([F.col("g0"), F.col("g1")]).alias("fp"),
                     _composed([F.col("g0") - F.col("t0"), F.col("g1") - F.col("t1")]).alias("pfp"), "tk", "bytes", F.col("r").alias("ref"))
    return stored(roots.unionByName(heads).unionByName(own), "trie-paths")


def _nodes(paths: DataFrame) -> DataFrame:
    """A row for every (depth, fingerprint): members, owner, and what the verification compares."""
    both = [f(c).alias(f"{f.__name__}_{c}") for c in ("tk", "pfp") for f in (F.min, F.max)]
    nodes = paths.groupBy("depth", "fp").agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("owner"), F.max("bytes").alias("bytes"), *both)
    return stored(nodes, "trie-nodes")


def _one_content_per_key(turns: DataFrame) -> bool:
    contents = turns.select("tk", "role", "text").distinct().groupBy("tk").agg(F.count(F.lit(1)).alias("n"))
    return contents.where("n > 1").isEmpty()


def turn_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role"), F.col("text"))


def verified(conversations: DataFrame, key: Callable[[int], Column] = turn_key) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans, path rows, nodes) under the first seed whose fingerprints pass the verification."""
    base = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text")).where(F.col("c").isNotNull())
    for seed in range(ATTEMPTS):
        turns = base.withColumn("tk", key(seed)).withColumn("bytes", F.octet_length("text").cast("long"))
        if not _one_content_per_key(turns):
            continue
        rows, xs = _numbered(turns, seed)
        plan = _plans(rows, xs)
        paths = _paths(rows, plan)
        nodes = _nodes(paths)
        if nodes.where("min_tk != max_tk or min_pfp != max_pfp").isEmpty():
            return plan, paths, nodes
    raise RuntimeError(f"turn keys or fingerprints collided under {ATTEMPTS} seeds")


def _id_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (depth, fp, c) to one row per node and batch: the ids as one string."""
    for b in batches:
        if len(b):
            edge = np.flatnonzero((np.diff(b["depth"]) != 0) | (np.diff(b["fp"]) != 0)) + 1
            ids = b["c"].astype(str).to_numpy()
            cuts = np.concatenate([[0], edge, [len(b)]])
            yield pd.DataFrame({"depth": b["depth"].to_numpy()[cuts[:-1]], "fp": b["fp"].to_numpy()[cuts[:-1]],
                                "first": b["c"].to_numpy()[cuts[:-1]],
                                "ids": [",".join(ids[i:j]) for i, j in zip(cuts, cuts[1:])]})


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted strings of ids to one hash per node; a node's strings go through the hash as they come."""
    node, state = None, None
    for b in batches:
        done = []
        for depth, fp, ids in zip(b["depth"], b["fp"], b["ids"]):
            if (depth, fp) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (depth, fp), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["depth", "fp", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "fp", "ends_sha256"])


def _ends(plan: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of the nodes at which rebuilt conversations end."""
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fp = F.when(F.col("own") > 0, _composed([F.col("e0"), F.col("e1")])).otherwise(_packed(F.col("f0"), F.col("f1")))
    ends = plan.select((F.col("m") + F.col("own")).alias("depth"), fp.alias("fp"), "c")
    runs = (ends.repartitionByRange(n, "depth", "fp", "c").sortWithinPartitions("depth", "fp", "c")
                .mapInPandas(_id_strings, "depth long, fp long, first long, ids string"))
    return (runs.repartition(n, "depth", "fp").sortWithinPartitions("depth", "fp", "first")
                .mapInPandas(_hashes, "depth long, fp long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for every distinct prefix: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    ship_code(conversations.sparkSession)
    plan, paths, nodes = verified(conversations)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("min_pfp").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    chunk = F.floor(F.col("depth") / F.lit(BLOCK))
    nodes = stored(nodes.join(kids, ["depth", "fp"], "left").select(
        "depth", "fp", "owner", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("min_pfp").alias("pfp"), chunk.alias("chunk"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("w0"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("w1")), "trie-weights")

    # the rest of the owner's chain, in blocks of depths
    totals = nodes.groupBy("owner", "chunk").agg(F.sum("w0").alias("s0"), F.sum("w1").alias("s1"))
    below = Window.partitionBy("owner").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("owner", "chunk", *[F.coalesce(F.sum(f"s{i}").over(below), F.lit(0)).alias(f"s{i}") for i in (0, 1)])
    rest = Window.partitionBy("owner", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.join(totals, ["owner", "chunk"]).select("depth", "fp", "owner", "n_convs", "n_children", *[
        (F.col(f"s{i}") + F.sum(f"w{i}").over(rest)).alias(f"own{i}") for i in (0, 1)])

    # whole chains of the other members
    chains = stored(nodes.groupBy("owner").agg(F.min("depth").alias("top"), F.min_by("fp", "depth").alias("fp"), F.min_by("pfp", "depth").alias("pfp"),
                                               F.sum("w0").alias("all0"), F.sum("w1").alias("all1")), "trie-chains")
    above = _by_block(chains, F.lit(0).cast("long"), F.col("top") - 1, "owner", "top", "all0", "all1")
    others = paths.join(above, (F.col("c") == F.col("owner")) & (F.floor(F.col("depth") / F.lit(BLOCK)) == F.col("block"))).where("depth < top")
    others = others.groupBy("depth", "fp").agg(F.sum("all0").alias("other0"), F.sum("all1").alias("other1"))

    # a chain's first node hangs on another's; below it the owner stays
    root = nodes.where("depth = 0").agg(F.max("owner")).scalar()
    parents = nodes.select((F.col("depth") + 1).alias("top"), F.col("fp").alias("pfp"), F.col("owner").alias("parent"))
    hung = chains.where("top > 1").join(parents, ["top", "pfp"]).select(F.col("top").alias("depth"), "fp", "parent")
    hung = hung.unionByName(chains.where("top = 1").select(F.col("top").alias("depth"), "fp", root.alias("parent")))

    out = own
    for part in (others, hung, _ends(plan)):
        out = out.join(part, ["depth", "fp"], "left")
    total = lambda i: F.col(f"own{i}") + F.coalesce(f"other{i}", F.lit(0))
    return out.select(F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "owner")).alias("parent_conv_id"),
                      "n_convs", "n_children", total(0).alias("n_leaves"), total(1).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
