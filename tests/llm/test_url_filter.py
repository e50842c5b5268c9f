"""Operator 1 against brute force; the two ways of matching against each other."""

import random

from feedpulse.llm import url_filter as U

from llm_helpers import docs


def brute(url, rules, default="allow"):
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        n = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[:min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = []
    for verdict, rule in rules:
        h, p = U.split_rule(rule)
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com", "http://example.com/", "http://a.example.com/en/?q",
        "http://www.example.com/en/", "http://x.www.example.com/en/a#b", "http://net/es/", "http://a.net/es", "http://a.net/fr/é#", "ftp://notexample.com/en/",
        "http://com:80/en/", "http://u@example.com/en/", "http://example.com?x=/en/", "http://ÄB.com/", "a://b://c.com/", "http://example.com./en/",
        "http://..com/", "http://example.com/en/\nx", "http://" + "a." * 300 + "net/fr/" + "p" * 3000]


def pages(spark, urls):
    df = docs(spark, list(enumerate(urls)), extra=("host", "path", "rule", "verdict", "k"))
    return df.withColumnsRenamed({"doc_id": "page_id", "text": "url"})


def test_fixed_rules(spark):
    got = U.judge(pages(spark, URLS)).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]], U.RULES)


def test_random_rules_both_ways(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choices(["a", "b", "cc", "net"], k=rng.randrange(1, 4))) for _ in range(60)]
    paths = ["", "/", "/x", "/x/", "/x/y", "/é"]
    rules = sorted({rng.choice(hosts) + rng.choice(paths) for _ in range(80)})
    rules = [("allow" if i % 2 else "block", r) for i, r in enumerate(rules)] + [("block", rules[1])]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?q', '#f'])}" for _ in range(300)]
    table = spark.createDataFrame(rules, "verdict string, rule string")
    strict = {r: v for v, r in sorted(rules)}  # block wins
    expected = {i: brute(u, [(v, r) for r, v in strict.items()]) for i, u in enumerate(urls)}
    mapped = U.judge(pages(spark, urls), table).collect()
    joined = U.judge_by_join(U.parts(pages(spark, urls)), table).collect()
    for got in (mapped, joined):
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == expected


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(U, "key", lambda s: 42)
    U.write_index([("block", "a.com/x"), ("allow", "b.com/y")], str(tmp_path / "i"))
    index = U.DigestIndex(str(tmp_path / "i"))
    assert index.judge(["b.com", "a.com", "a.com"], ["/y", "/x1", "/y"]) == [("b.com/y", "allow"), ("a.com/x", "block"), (None, None)]


def test_empty_tables(spark, tmp_path):
    assert U.judge(pages(spark, URLS).limit(0)).count() == 0
    U.write_index([], str(tmp_path / "e"))
    assert U.DigestIndex(str(tmp_path / "e")).judge(["a.com"], ["/"]) == [(None, None)]
