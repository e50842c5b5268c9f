"""Operator 10 against brute force."""

import random
import re
from collections import Counter

from feedpulse.llm import quality

from llm_helpers import ODD_TEXTS, docs, prose, words


def brute(text):
    w = words(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def table(spark):
    rng = random.Random(1)
    once = prose(rng, 60)
    texts = [*ODD_TEXTS, once, once, once + " " + once, "same words " * 40, "\n".join(["a line of text"] * 5 + ["", " ", "end"]),
             "A%%% b### c<x>&|", prose(rng, 4000, 30), "a b c d e f g h " * 2 + prose(rng, 20), "UPPER CASE " * 30]
    return list(enumerate(texts)) + [(None, once), (3, "a"), (3, "a")]


def test_ledger_equals_brute_force(spark):
    rows = table(spark)
    led = quality.apply_policy(quality.ledger(docs(spark, rows)))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in led.collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)
    for r in led.collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_ablations_equal_policies_without_a_rule(spark):
    led = quality.ledger(docs(spark, table(spark)))
    bits = [r["fail_bits"] for r in led.collect()]
    own = quality.POLICIES["v2"]
    kept = sum(not b & own for b in bits)
    for r in quality.ablations(led, "v2").collect():
        without = own & ~quality.BIT[r["rule"]]
        assert r["n_kept"] == kept and r["n_failed"] == sum(bool(b & quality.BIT[r["rule"]]) for b in bits)
        assert kept + r["n_only_this"] == sum(not b & without for b in bits)


def test_keep_documents_and_empty_table(spark):
    d = docs(spark, table(spark))
    led = quality.apply_policy(quality.ledger(d))
    kept = quality.keep_documents(d)
    assert kept.columns == d.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in led.filter("kept").collect())
    assert quality.ledger(d.limit(0)).count() == 0 and quality.keep_documents(d.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.keep_documents(docs(spark, table(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
