"""Operator 12: Merkle manifest of a table, by slot pivot.

Every row is a leaf: the digest of its fields. Leaves of a group (say, a language) ascend by key; runs
of ``fanout`` nodes become one, until one is left, the group's subroot; the subroots, ordered by group,
become the root the same way. ``manifest`` returns for every row its leaf, subroot, root and proof (the
siblings on the way up, with its own slot among them), and ``fold`` recomputes a root from a leaf and
its proof, so a changed row shows.

A step is one aggregate: conditional aggregates spread a parent's children into slot columns (``fanout``
to the power ``depth`` of them, so that one shuffle serves ``depth`` levels), concatenated slots are
hashed level by level, and omitting a node's own slot gives its siblings. Rows never gather by group:
places come from sampled ranges, and a parent has a bounded number of children. Each step has a
``fanout ** depth``-th of the rows of the one below, is written once, and is read again on the way down,
where the proofs of blocks are joined by place (unique on both sides, so nothing is skewed).

Defined results: nulls in fields are hashed as ``-``; a null group is a group, the first one; null keys
come first; rows with equal keys are ordered by their leaf (equal rows are interchangeable); a group of
one row has its leaf as subroot, a single subroot is the root; an empty table gives no rows; other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import stored
from feedpulse.llm.order import ranked

FANOUT = 2
DEPTH = 4  # levels per step: 16 slot columns
SMALL_GROUPS = 100_000  # up to so many groups their table is broadcast; beyond, it is joined by shuffle
PROOF = "array<struct<slot:int,siblings:array<string>>>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenation."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(c: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(*values: Column) -> Column:
    return digest_of(*[field(c) for c in values])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` has with the siblings of ``proof``."""
    def up(node: Column, level: Column) -> Column:
        before = F.slice(level["siblings"], F.lit(1), level["slot"])
        after = F.slice(level["siblings"], level["slot"] + 1, F.greatest(F.size(level["siblings"]) - level["slot"], F.lit(0)))
        return digest_of(F.array_join(before, ""), node, F.array_join(after, ""))
    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, from the leaf's to the root's children, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda x: x["siblings"])), ""), 256)


def _nodes_at(level: int, fanout: int) -> Column:
    """How many nodes the tree of a block's group has, ``level`` levels above the block's slots."""
    return F.ceil(F.col("n") / F.lit(fanout ** level))


def _blocks(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Nodes (g, pos, n, h and maybe a payload p) to blocks (g, pos, n, slot columns s<level>_<slot>)."""
    width = fanout ** depth
    slot = F.pmod("pos", F.lit(width))
    payload = "p" in nodes.columns
    aggs = [F.max(F.when(slot == i, F.col("h"))).alias(f"s0_{i}") for i in range(width)]
    aggs += [F.max(F.when(slot == i, F.col("p"))).alias(f"p_{i}") for i in range(width) if payload]
    out = nodes.groupBy("g", F.floor(F.col("pos") / F.lit(width)).alias("block")).agg(F.max("n").alias("n"), *aggs).withColumnRenamed("block", "pos")
    for level in range(1, depth + 1):
        alone = _nodes_at(level - 1, fanout) <= 1
        new = []
        for j in range(width // fanout ** level):
            kids = [F.col(f"s{level - 1}_{j * fanout + k}") for k in range(fanout)]
            parent = F.when(kids[0].isNotNull(), digest_of(*kids))
            new.append((F.when(alone, kids[0]) if j == 0 else F.when(alone, None)).otherwise(parent).alias(f"s{level}_{j}"))
        out = out.select("*", *new)
    return out


def _unpacked(blocks: DataFrame, up: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The nodes of ``blocks`` again (g, pos, h, maybe p), each with its proof and the other columns of ``up``."""
    width = fanout ** depth
    payload = "p_0" in blocks.columns
    carried = [c for c in up.columns if c not in ("g", "pos", "h", "p", "proof")]
    kids = []
    for i in range(width):
        levels = []
        for level in range(depth):
            a = i // fanout ** level
            first = a - a % fanout
            others = F.array_compact(F.array(*[F.col(f"s{level}_{first + k}") for k in range(fanout) if k != a % fanout]))
            levels.append(F.when(_nodes_at(level, fanout) > 1, F.array(F.struct(F.lit(a % fanout).alias("slot"), others.alias("siblings"))))
                           .otherwise(F.array().cast(PROOF)))
        parts = [F.lit(i).alias("slot"), F.col(f"s0_{i}").alias("h"), F.concat(*levels).alias("proof")]
        kids.append(F.struct(*parts, *([F.col(f"p_{i}").alias("p")] if payload else [])))
    joined = blocks.join(up.select(F.col("g").alias("up_g"), F.col("pos").alias("up_pos"), F.col("proof").alias("up_proof"), *carried),
                         (F.col("g") == F.col("up_g")) & (F.col("pos") == F.col("up_pos")))
    rows = joined.select("g", "pos", "up_proof", *carried, F.explode(F.filter(F.array(*kids), lambda k: k["h"].isNotNull())).alias("k"))
    return rows.select("g", (F.col("pos") * width + F.col("k.slot")).alias("pos"), F.col("k.h").alias("h"),
                       F.concat("k.proof", "up_proof").alias("proof"), *carried, *(["k.p"] if payload else []))


def _climb(nodes: DataFrame, most: int, fanout: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """All steps of the trees of ``nodes``, the largest of ``most`` leaves, and their tops."""
    steps = []
    while not steps or most > 1:
        steps.append(stored(_blocks(nodes, fanout, depth), "merkle-step"))
        width = fanout ** depth
        nodes = steps[-1].select("g", "pos", _nodes_at(depth, fanout).cast("long").alias("n"), F.col(f"s{depth}_0").alias("h"))
        most = -(-most // width)
    return steps, nodes


def manifest(df: DataFrame, fields: Sequence[str], key: str, group: str, extra: dict[str, Column] | None = None,
             fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``df``: ``key``, the columns ``extra`` (computed on ``df``'s rows), leaf, subroot, root, proof."""
    extra = extra or {}
    payload = F.struct(F.col(key).alias("key"), *[c.alias(f"x{i}") for i, c in enumerate(extra.values())])
    leaves = df.select(F.col(group).alias("grp"), F.col(key).alias("k"), leaf_of(*[F.col(c) for c in fields]).alias("h"), payload.alias("p"))
    rows = ranked(leaves, [F.col("grp"), F.col("k"), F.col("h")], "merkle-leaves")
    groups = stored(rows.groupBy("grp").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    # groups in the leaves' order: their first rows ascend with them
    groups = stored(ranked(groups, [F.col("first")], "merkle-group-order", "g"), "merkle-groups")
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    side = groups.select(F.col("grp").alias("grp_of"), "g", "n", "first")
    side = F.broadcast(side) if size["groups"] <= SMALL_GROUPS else side
    nodes = (rows.join(side, F.col("grp").eqNullSafe(F.col("grp_of")))
                 .select("g", (F.col("r") - F.col("first")).alias("pos"), "n", "h", "p"))
    steps, tops = _climb(nodes, size["most"] or 0, fanout, depth)
    roots = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(size["groups"]).cast("long").alias("n"), "h")
    root_steps, root = _climb(roots, size["groups"], fanout, depth)
    up = root.select("g", "pos", F.array().cast(PROOF).alias("proof"), F.col("h").alias("root"))
    for s in reversed(root_steps):
        up = _unpacked(s, up, fanout, depth)
    up = up.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "proof", "root", F.col("h").alias("subroot"))
    for s in reversed(steps):
        up = _unpacked(s, up, fanout, depth)
    return up.select(F.col("p.key").alias(key), *[F.col(f"p.x{i}").alias(c) for i, c in enumerate(extra)],
                     F.col("h").alias("leaf"), "subroot", "root", "proof")


def tampered_leaf() -> Column:
    """The leaf after tampering: where 7 divides the CRC of the decimal id, 1 is added to n_chars."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    n = (F.col("n_chars").cast("decimal(20,0)") + more).cast("decimal(20,0)")
    changed = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    return F.when((more == 1) & F.col("n_chars").isNotNull(), changed)


def check_documents(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof digest of every document, and the root that it folds to when some are tampered with."""
    out = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"tampered": tampered_leaf()})
    out = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
