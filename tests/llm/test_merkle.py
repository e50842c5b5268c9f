"""Merkle manifests against a plain recursive version."""

import hashlib
import random
import zlib

import pytest
from llm_helpers import ODD_TEXTS
from pyspark.sql import functions as F

from feedpulse.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fanout):
    """Levels from the leaves to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        out.append((at % fanout, [x for k, x in enumerate(level[first:first + fanout]) if k != at % fanout]))
        at //= fanout
    return out


def folded(node, proof):
    for own, sib in proof:
        node = h(*sib[:own], node, *sib[own:])
    return node


def brute(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(climb([leaf(r) for r in groups[g]], fanout))
    top = climb([t[-1][0] for t in trees], fanout) if trees else None
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            proof = path(trees[k], at, fanout) + path(top, k, fanout)
            changed = r
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                changed = (*r[:3], r[3] + 1, r[4])
            root = folded(leaf(changed), proof)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*[x for _, s in proof for x in s]), root, root == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    extra = ("leaf", "g", "pos", "n", "h", "p", "grp", "root")
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in extra])


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(-5, 10 ** 6), rng.choice(["web", "", None, "é"]), rng.choice(langs), rng.choice([None, 3, 10 ** 9]),
             rng.choice(ODD_TEXTS)) for _ in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, [None]), (37, ["en", None, "", "fr", "\U0001F389", "￮"]), (300, ["en"] * 9 + ["de"])])
def test_against_brute_force(spark, n, langs):
    rows = rows_of(n, langs)
    got = [tuple(r) for r in merkle.check_documents(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(7, "a", "en", 1, "x")] * 5 + [(7, "a", "en", 1, None), (None, None, None, None, None), (None, None, None, None, None), (7, "a", None, 1, "x" * 100_000)]
    got = [tuple(r) for r in merkle.check_documents(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert merkle.check_documents(frame(spark, [])).collect() == []


@pytest.mark.parametrize("fanout, depth", [(3, 2), (4, 1), (2, 1)])
def test_other_fanouts(spark, fanout, depth):
    rows = rows_of(60, ["en", "de", "fr", "es", None], 3)
    out = merkle.manifest(frame(spark, rows), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", fanout=fanout, depth=depth)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == [r[:5] for r in brute(rows, fanout)]
    assert all(r[5] == r["root"] for r in got)


def test_a_changed_row_shows(spark):
    rows = [(i, "a", "en", i, f"t{i}") for i in range(40)]
    out = merkle.check_documents(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in out if not r["verified"]} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}
