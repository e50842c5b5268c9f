"""Secret scans against a brute-force version that counts every window anew."""

import hashlib
import math
import random
import re
from collections import Counter

from llm_helpers import ODD_TEXTS, docs
from pyspark.sql import functions as F

from feedpulse.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = sorted(spans)
    for i, c in enumerate(secrets.CLASSES):
        last = 0
        for m in re.finditer("[%s]{%d,}" % (re.escape(c.letters), c.window), text):
            before, last = text[last:m.start()][-secrets.CONTEXT:], m.end()
            if any(re.search(p, m[0]) for p in secrets.ALLOW) or any(re.search(p, before) for p in secrets.ALLOW_BEFORE):
                continue
            marked = set()
            for s in range(len(m[0]) - c.window + 1):
                n = Counter(m[0][s:s + c.window])
                if -sum(v / c.window * math.log2(v / c.window) for v in n.values()) >= c.bits - 1e-9:
                    marked.update(range(s, s + c.window))
            for a in sorted(marked):
                if a - 1 not in marked:
                    b = a
                    while b in marked:
                        b += 1
                    spans.append((m.start() + a, 3 + i, m.start() + b, c.kind))
    count = Counter(s[1] for s in base)
    listed = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(x))
    return count[0], count[1], count[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)


def texts():
    rng = random.Random(5)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64 = secrets.CLASSES[2].letters
    out = list(ODD_TEXTS) + [
        "token=secret:abcdefghij password = 'short' API_KEY: \"abcd.efgh+1\" é🎉 Secret=12345678 ſecret=12345678 toKen=12345678",
        "apikey=apikey=apikey=abcdefgh token:token = abcdefghi", "AKIA AKIAAKIAAKIA123 xAKIA123456789012 AKIA12345678901",
        "f" * 31 + " " + "f" * 32 + "g" + "0123456789abcdef" * 3, "sha256-" + pick(b64, 43), "checksum: " + pick("0123456789abcdef", 31),
        "data:image/png;base64," + pick(b64, 300), "550e8400-e29b-41d4-a716-446655440000", "0" * 40 + pick(b64, 60) + "a" * 40,
        pick(b64, 30) + "a" * 30 + pick(b64, 30), "some-long-identifier-of-words", pick(b64, secrets.BLOCK * 2 + 11),
        "A" * (secrets.BLOCK + 5) + pick(b64, 40) + "B" * secrets.BLOCK, "token=12345678 " * 700, pick(secrets.CLASSES[1].letters, 25)]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 12)):
            words.append(rng.choice([pick("abcdef0123456789", rng.randrange(20, 45)), pick(b64, rng.randrange(20, 60)), pick("ab1", 40),
                                     "token", "passwd", "=", ": ", "\"", "'", " ", "\n", "ü", pick("xyz", 5), "AKIA" + pick("AB12", 14)]))
        out.append(rng.choice(["", " "]).join(words))
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [rows[9], (None, "token=12345678"), (7, None)]
    got = secrets.digest(docs(spark, rows, extra=("spans", "kind", "text_col", "n_assign"))).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum("entropy" in w[-1] for w in want) > 50


def test_allow_list_and_redaction(spark):
    df = docs(spark, [(1, "key k9Xv2Lq8RtZ4mWb7YcN1pQ5sD3fG6hJ0 end"), (2, "a token=12345678"), (3, None), (4, "clean")], extra=("spans",))
    assert [r[0] for r in secrets.redact(df).orderBy("doc_id").select("text").collect()] == ["key [secret] end", "a [secret]", None, "clean"]
    assert secrets.redact(df).columns == df.columns
    plain = secrets.redact(df, allow=["^k9Xv"]).orderBy("doc_id").select("text").collect()
    assert [r[0] for r in plain] == ["key k9Xv2Lq8RtZ4mWb7YcN1pQ5sD3fG6hJ0 end", "a [secret]", None, "clean"]  # base spans stay
    assert secrets.scan(df).columns[-1] == "_spans"


def test_empty_and_native(spark):
    df = docs(spark, []).select("*", F.lit("x").alias("lang"))
    out = secrets.digest(df)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
