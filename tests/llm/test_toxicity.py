"""Operator 2: held-out accuracy, disguises, defined results."""

import math
import random

import numpy as np
import pytest

from feedpulse.llm import toxicity as T

from llm_helpers import ODD_TEXTS, docs, prose

BAD = ["idiot", "moron", "worthless", "pathetic", "stupid"]


def sample(rng, n):
    rows, labels = [], []
    plain = ["the", "a", "of", "storm", "paper", "letter", "window", "morning", "garden", "simple", "winter", "table", "people", "little", "class", "street"]
    for i in range(n):
        w = rng.choices(plain, k=rng.randrange(5, 60)) + [f"n{rng.randrange(4000)}" for _ in range(8)]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD + ["grimble" + rng.choice(["ed", "ing", "ous", "ment", "ful"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = sample(random.Random(14), 1500)
    d = docs(spark, rows + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "you idiot"), (5, "repeated id")], extra=("toxic", "words", "score"))
    lab = spark.createDataFrame(labels + [(None, 1), (20_000, None), (3, 0), (3, 0)], "doc_id bigint, toxic int")
    return d, lab, labels, T.fit(d, lab)


def test_held_out_accuracy(fitted):
    d, lab, labels, _ = fitted
    got = T.score(d, lab).collect()
    known = dict(labels)
    out = [(known[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in known and r["doc_id"] != 5]
    assert len(out) > 300 and sum(a == b for a, b in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert len(got) == d.count()
    none = {r["doc_id"]: r for r in got}
    assert none[10_000]["predicted"] == none[10_001]["predicted"] == 0 and none[None]["predicted"] == 1 and not none[None]["held_out"]


@pytest.mark.parametrize("text, word", [
    ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("what an i d i o t !", "idiot"), ("idioooot", "idiot"), ("m0r0n!!!", "moron"), ("wor-th-less", "worthless"),
    ("p@thet1c", "pathetic"), ("$tup1d", "stupid"), ("ïdïöt", "idiot"), ("i_d_i_o_t", "idiot"), ("1 d 1 0 t", "idiot"), ("IDIOT?", "idiot"), ("mo ron", "moron"),
    ("stuuupiiid", "stupid"), ("grimbl3ment", "grimble")])
def test_disguises_are_read(fitted, text, word):
    model = fitted[3]
    r = T.Reader(model["words"], model["lm"])
    assert any(model["words"][i].startswith(word[:7]) for i in r.words(f"the {text} of")), (model["words"], T.restore(text, model["lm"]))


def test_clean_words_stay_clean(fitted):
    r = T.Reader(fitted[3]["words"], fitted[3]["lm"])
    for text in ("storm class people", "10% of 1,000 $5", "a b c d e f", "more on the", "www.example.com/id10", "555-9913", "a a a a a a", "!!! ***"):
        assert not r.words(text), text


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(15)
    counts = rng.poisson(0.05, T.SYMBOLS ** T.ORDER).astype(float)
    p = np.exp(T.language_model(counts).astype(float)).reshape(-1, T.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and (p > 0).all()


def test_decode_is_the_best_path(fitted):
    """Brute force over all readings of short lattices."""
    import itertools
    lm = fitted[3]["lm"]

    def cost(text, paid):
        s, v = 0, -paid
        for c in text:
            k = T.char_class(c)
            if not (k == 0 and s % T.SYMBOLS == 0):
                v += float(lm[s * T.SYMBOLS + k])
                s = (s * T.SYMBOLS + k) % T.SYMBOLS ** 3
        return v + float(lm[s * T.SYMBOLS])

    for token in ("1d10t", "m0r-on", "ss!l", "i d i", "§x1"):
        best = max(cost("".join(c[0] for c in path), sum(c[1] for c in path)) for path in itertools.product(*T.lattice(token)))
        own = T.decode(token, lm)
        paid = min(sum(c[1] for c in path) for path in itertools.product(*T.lattice(token)) if "".join(c[0] for c in path) == own)
        assert math.isclose(cost(own, paid), best, rel_tol=1e-6)


def test_grams_are_counted_over_all_texts(spark):
    rng = random.Random(16)
    texts = [prose(rng, 30), None, "", "Ab é", "x"]
    got = T.count_grams(docs(spark, list(enumerate(texts))))
    want = np.zeros(T.SYMBOLS ** T.ORDER)
    for t in texts:
        if t:
            c = [0, *(0 if b in b" \t\n\x0b\x0c\r" else T.char_class(chr(b).lower()) if chr(b).isascii() else 27 for b in t.encode()), 0, 0, 0]
            for i in range(len(c) - 3):
                want[((c[i] * 28 + c[i + 1]) * 28 + c[i + 2]) * 28 + c[i + 3]] += 1
    inner = want > 0
    assert np.array_equal(got[inner], want[inner]) or np.abs(got - want).sum() <= 3 * len(texts)


def test_without_labels_or_rows(spark):
    d = docs(spark, [(1, "you idiot"), (2, None)])
    lab = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["predicted"] for r in T.score(d, lab).collect()] == [0, 0]
    assert T.score(d.limit(0), lab).count() == 0
    kept = T.keep_documents(d, lab)
    assert kept.columns == d.columns and kept.count() == 2


@pytest.mark.parametrize("text", ["i - d - i - o - t", "i . d . i . o . t", "i * d * i * o * t", "i.. d.. i.. o.. t", "i _ d _ i _ o _ t", "- i - d - i - o - t -",
                                  "i.d i.o t", "i\nd\ni\no\nt", "i    d    i    o    t", "(i - d - i - o - t)", "i, d, i, o, t!", "1 - d - 1 - 0 - t"])
def test_spaced_words_are_read(fitted, text):
    model = fitted[3]
    r = T.Reader(model["words"], model["lm"])
    for around in ("the {} of", "{}", "garden. {}"):
        assert "idiot" in {model["words"][i] for i in r.words(around.format(text))}, around


def test_spaced_runs_are_those_of_the_expression():
    import itertools
    import re
    rule = re.compile(r"(?<!\S)(?:\S[ \t.\-_*]{1,3}){2,}\S(?!\S)")
    texts = ["".join(x) for n in range(5, 9) for x in itertools.product("a- \n", repeat=n)]
    rng = random.Random(17)
    texts += ["".join(rng.choices("ab1  \t.-_*\n", k=rng.randrange(5, 30))) for _ in range(20_000)]
    for text in texts:
        got, want = list(T.spaced(text)), [m.span() for m in rule.finditer(text)]
        assert all(rule.fullmatch(run) and text[i:j] == run for i, j, run in got)
        assert bool(got) == bool(want) and (not got or got[0][0] == want[0][0] and got[0][1] >= want[0][1]), text
        for i, j in want:  # nothing that the expression finds is left out
            inside = [k for k in range(i, j) if not any(a <= k < b for a, b, _ in got)]
            assert all(text[k] in " \t.-_*" for k in inside), text
    assert list(T.spaced("-" * 5000 + "ab")) == []  # in linear time


def model_of(entries, fitted):
    """A reader of given entries under the language model of the fitted texts' letters."""
    counts = np.full(T.SYMBOLS ** T.ORDER, 0.01)
    for w in ["the", "a", "of", "storm", "paper", "letter", "window", "morning", "garden", "people"] * 200:
        c = [0, *map(T.char_class, w), 0, 0, 0]
        for i in range(len(c) - 3):
            counts[((c[i] * 28 + c[i + 1]) * 28 + c[i + 2]) * 28 + c[i + 3]] += 1
    return T.Reader(entries, T.language_model(T.boosted(counts, entries)))


@pytest.mark.parametrize("entry, text", [("idiot", "i|d|i|o|t"), ("idiot", "i!d!i!o!t"), ("moron", "m+o+r+o+n"), ("moron", "m@o@r@o@n"), ("stup*", "sttupid"), ("stup*", "stupppid"),
                                         ("stup*", "s|t|u|p|i|d"), ("débile", "d.e.b.i.l.e"), ("débile", "d3bil3"), ("débi*", "d é b i l e"), ("stup*", "st upid"), ("débile", "dé bile")])
def test_all_readings_reach_the_decoder(fitted, entry, text):
    assert model_of([entry, "filth"], fitted).words(f"the {text} of") == {0}


def test_prefilter_and_decoder_equal_the_decoder_alone(fitted):
    import itertools
    rng = random.Random(18)
    entries = ["sit", "b00b", "boob", "léger", "lil", "stup*", "éclat*", "aaa", "good", "дурак"]
    r = model_of(entries, fitted)
    tokens = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("sit1|-", repeat=n)]
    tokens += ["".join(rng.choices("situpblgeroacd" + "sit" * 3 + "01358!|+(<@$éл-.'２ⓐ", k=rng.randrange(2, 9))) for _ in range(6000)]
    for w in ("sit", "boob", "leger", "stupid", "eclats", "good", "lil"):  # disguised entries
        for _ in range(300):
            t = "".join(rng.choice([c, c, c + c, c + c + c, c + rng.choice("|!+-.@$<"), {"i": "1", "o": "0", "e": "é", "s": "$", "t": "+", "l": "|", "b": "8"}.get(c, c)]) for c in w)
            tokens.append(rng.choice(["", "", "x-", "("]) + t + rng.choice(["", "", "!", "-x", "|"]))
    n = 0
    for t in tokens:
        bare = t.strip(T._EDGE)
        got = r.entry(bare)
        want = (got,) if got is not None else tuple(r.reading(t)) or tuple(r.reading(bare))
        assert r._token(t) == want, t
        paths = itertools.product(*[[e for e, _ in c] for c in T.lattice(t)]) if len(T.lattice(t)) < 6 else ()
        if any(r._look(w, r.read) is not None for path in paths for w in "".join(path).split()):
            assert r.can_read(t), t
        n += bool(want)
    assert n > 500
