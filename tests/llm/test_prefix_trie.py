"""The prefix trie against a version that rebuilds every conversation."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from feedpulse.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c in turns:
        turns[c] = [x[2:] for x in sorted(turns[c])]
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        b = c - int(c - 5 * int(c / 5))
        built[c] = tuple(turns.get(b, [])[:h] + turns[c][h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids.get(s, [])) or 1
        saved[s] = sum(saved[k] for k in kids.get(s, [])) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("c", "r", "depth", "fp", "tk", "owner", "block", "bytes")])


def random_rows(n, seed, longest=12, vocabulary=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, n * 2), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None, ""]), rng.choice([None, "", "é🎉", "a b"][:vocabulary])))
    return rows


@pytest.mark.parametrize("n, seed, vocabulary", [(1, 1, 3), (40, 2, 2), (120, 3, 4), (200, 4, 1)])
def test_against_brute_force(spark, n, seed, vocabulary):
    rows = random_rows(n, seed, vocabulary=vocabulary)
    got = [tuple(r) for r in prefix_trie.trie(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_repeats_long_texts_and_null_ids(spark):
    rows = [(c, t, "user", "same" * 30_000 if t == 2 else f"t{t}") for c in range(30) for t in range(4)]
    rows += [(3, 1, "user", "t1")] * 4 + [(None, 1, "user", "x")] * 3 + [(7, None, None, None)] * 2 + [(50, 0, "user", "t0")]
    got = [tuple(r) for r in prefix_trie.trie(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_a_conversation_longer_than_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rows = [(10, t, "u", f"w{t % 7}") for t in range(90)] + [(11, t, "u", f"w{t % 7}") for t in range(70)] + random_rows(30, 9)
    got = [tuple(r) for r in prefix_trie.trie(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert prefix_trie.trie(frame(spark, [])).collect() == []
    assert prefix_trie.trie(frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_colliding_keys_are_found(spark):
    """A key under which unlike turns look equal is refused, and the next one is taken."""
    rows = random_rows(20, 5)
    weak = lambda seed: F.lit(1).cast("long") if seed == 0 else prefix_trie.turn_key(seed)
    _, _, nodes = prefix_trie.verified(frame(spark, rows), weak)
    assert nodes.count() == len(brute(rows))
    with pytest.raises(RuntimeError):
        prefix_trie.verified(frame(spark, rows), lambda seed: F.lit(1).cast("long"))
