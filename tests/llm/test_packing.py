"""Operator 5: pieces, plan and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedpulse.llm import packing

from llm_helpers import ODD_TEXTS, docs, prose


def filled(hist, capacity=64, **kw):
    rows, used = packing.plan(hist, capacity, **kw)
    seqs, ranks = defaultdict(list), defaultdict(list)
    for n, first, count, per, seq, at in rows:
        for k in range(count):
            ranks[n].append(first + k)
            seqs[seq + k // per].append((at + k % per * n, n))
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in hist.items())
    for v in seqs.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= capacity
    assert len(seqs) <= used
    return len(seqs)


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=40), st.integers(1, 20))
def test_plan_places_every_piece_once(hist, groups):
    filled(hist, groups=groups)


def test_plan_is_near_the_least():
    rng = random.Random(6)
    hist = defaultdict(int)
    for _ in range(50_000):
        hist[min(2048, int(rng.lognormvariate(6.3, 1.1)) + 1)] += 1
    least = -(-sum(n * c for n, c in hist.items()) // 2048)
    assert filled(dict(hist), 2048) <= 1.005 * least


def test_pack_contract(spark):
    rng = random.Random(7)
    texts = [*ODD_TEXTS, "<|endoftext|> and text", "it's we'll  two  spaces", prose(rng, 9000, 5000), *[prose(rng, rng.randrange(1, 900)) for _ in range(40)]]
    rows = list(enumerate(texts)) + [(3, "a"), (3, "a")]
    got = packing.pack(docs(spark, rows + [(None, "x")])).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 2048
    for i, t in enumerate(texts):
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        v = sorted(by[i], key=lambda r: r["piece"])
        if i == 3:
            assert len(v) == 3
            v = v[:1]
        end = 0
        for k, r in enumerate(v):
            assert (r["piece"], r["start"]) == (k, end) and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(ids[end:end + r["length"]].tobytes())
            end += r["length"]
        assert end == len(ids)
    assert len(by[None]) == 1
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0
