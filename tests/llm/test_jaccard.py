"""Operator 6 against brute force: links, chains, hot groups, odd rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from feedpulse.llm import components, jaccard
from feedpulse.llm.common import window_hashes, word_chunks, word_hashes

from llm_helpers import ODD_TEXTS, docs, prose, words

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    both = defaultdict(int)
    for v in at.values():
        for k, a in enumerate(v):
            for b in v[:k]:
                both[min(a, b), max(a, b)] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def rows_of_all_kinds():
    rng = random.Random(9)
    base, long_one, passage = prose(rng, 120, 3000), prose(rng, 1500, 3000), prose(rng, 60, 3000)
    chain = [prose(rng, 100, 3000)]
    for _ in range(6):  # each links with the next, the ends do not link
        chain.append(edited(rng, chain[-1], 2))
    texts = [*ODD_TEXTS, *ODD_TEXTS, base, base.upper(), *[edited(rng, base, rng.randrange(0, 5)) for _ in range(60)],
             long_one, edited(rng, long_one, 20), edited(rng, long_one, 60), *chain,
             *[prose(rng, rng.randrange(1, 80), 3000) + " " + passage for _ in range(60)], "one two three four five", "one two three four five six",
             "a b", "A  b\n", *[" ".join(map(str, range(k, k + 45 + k % 3))) for k in range(12)]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_components_equal_brute_force(spark):
    rows = rows_of_all_kinds()
    got = jaccard.join(docs(spark, rows + [(None, "one two three four five"), (None, None)])).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["n_shingles"] == 0] == [None]


def test_every_stage_with_tiny_bounds(spark, monkeypatch):
    """Common shingles from two documents on, few of them broadcast, and small trials per task."""
    monkeypatch.setattr(jaccard, "COMMON_FROM", 2)
    monkeypatch.setattr(jaccard, "MAX_COMMON", 150)
    monkeypatch.setattr(jaccard, "SALT_PAIRS", 7)
    rows = rows_of_all_kinds()
    got = jaccard.join(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_keep_documents(spark):
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (7, "x"), (7, "x"), (None, "x"), (8, None)]
    d = docs(spark, rows)
    kept = jaccard.keep_documents(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 7), (False, 8), (True, 0)]
    assert jaccard.join(d.limit(0)).count() == 0


def test_keep_documents_that_share_an_id(spark):
    rows = [(7, "a b c d e f"), (7, "u v w x y z"), (7, "U v w x y z"), (3, "k l m n o p"), (7, "k l m n o p"), (9, "A b c d e f"), (9, "g h i j k l"),
            (None, "g h i j k l"), (None, "g h i j k l"), (4, None), (4, "alone here")]
    kept = jaccard.keep_documents(docs(spark, rows, extra=("row_id", "gone_id", "node", "n", "th")))
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept.collect())
    assert got == [(0, "g h i j k l"), (0, "g h i j k l"), (3, "k l m n o p"), (4, ""), (4, "alone here"), (7, "a b c d e f"), (7, "u v w x y z"),
                   (9, "g h i j k l")]


def test_signature_bounds_the_overlap():
    rng = np.random.default_rng(10)
    for _ in range(200):
        x = np.unique(rng.integers(0, 3000, rng.integers(1, 2900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, rng.integers(0, 400)).astype(np.uint64)]))
        a, b = jaccard.signature(x), jaccard.signature(y)
        assert jaccard.differing([a, b, a], [b, a, a]).tolist()[2] == 0
        assert 0 <= jaccard.differing([a], [b])[0] == jaccard.differing([b], [a])[0] <= len(np.setxor1d(x, y))


def test_components_of_links(spark):
    rng = random.Random(11)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i, 99) for i in range(50)],
                  [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], []):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert all(got.get(x, x) == find(x) for x in root) and set(got) <= set(root)


def test_word_hashes_know_words_and_places():
    texts = ["b a\tb  a\n", "a", None, "", "\x0b", "é a"]
    for lower in (False, True):
        rows = []
        for first, last, data, start, end, h, bounds in word_chunks(texts, lower, limit=6):
            for i in range(first, last):
                rows.append([(data[a:b], x) for a, b, x in zip(start[bounds[i - first]:bounds[i - first + 1]], end[bounds[i - first]:], h[bounds[i - first]:])])
        assert [[w for w, _ in r] for r in rows] == [[b"b", b"a", b"b", b"a"], [b"a"], [], [], [], ["é".encode(), b"a"]]
        assert len({x for r in rows for _, x in r}) == 3
    _, _, h = word_hashes(b"a b c a b c")
    w = window_hashes(h, 2)
    assert len(w) == 5 and w[0] == w[3] and w[1] == w[4] and len(set(w.tolist())) == 3
    assert len(window_hashes(h, 7)) == 0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 9, 10, 11, 100])
def test_prefix_length_is_enough(n):
    p = int(jaccard._needed(np.array([n]))[0])
    for m in range(1, 2 * n):  # an overlap that links leaves fewer than p shingles out
        least = next((o for o in range(min(n, m) + 1) if 100 * o >= 80 * (n + m - o)), None)
        assert least is None or n - least < p


def test_a_task_that_is_run_again_deals_the_same_groups(spark):
    """No random numbers: group numbers follow the task and its flush, and no two share one."""
    numbers = [jaccard.own_group(t, f) for t in (0, 1, 2, 99_999) for f in (1, 2, 3_000_000)]
    assert len(set(numbers)) == len(numbers) and max(numbers) < 0 and min(numbers) > -2**63
    rng = random.Random(8)
    common = prose(rng, 12)
    texts = jaccard._texts(docs(spark, [(i, common + " " + prose(rng, 20)) for i in range(60)]), "doc_id", "text")
    table = jaccard.common_shingles(texts, 60)
    deal = lambda: sorted(tuple(r) for r in jaccard.tiles(texts, table).collect())
    assert deal() == deal()
