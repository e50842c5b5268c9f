"""Operator 1, URL filters: a sorted digest array that tasks map into memory.

The index is one file: the sorted 64-bit xxhash keys of all rules (host + path prefix), the
sorted keys of their hosts, and the full strings. A batch of URLs is probed by binary search
(``np.searchsorted``): first every suffix of the host among the host keys, then, for hosts that
have rules, the path prefixes of the lengths that occur in the index. A key that is found counts
only if the stored string is equal, so a digest collision never decides.

Spark ships the file to each executor, where all Python workers map the same pages. That is done
up to ``MAX_INDEX_BYTES`` of rules, which is checked; beyond it, the same keys are matched by a
shuffle join (``judge_by_join``).

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; an
empty host suffix fits no rule; among rules of equal length the one with the longer host wins,
then the one with the smaller string; repeated rules count once (block wins over allow); repeated
pages are judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedpulse.llm.common import ship_code

MAX_INDEX_BYTES = 512 * 1024 * 1024
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules that query op1 fixes.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))


def key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path prefix of a rule; the path starts at the first slash."""
    host, slash, rest = rule.partition("/")
    return host, slash + rest


def _heap(strings: list[str]) -> tuple[np.ndarray, bytes]:
    data = [s.encode("utf-8", "surrogatepass") for s in strings]
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in data], out=at[1:])
    return at, b"".join(data)


def write_index(rules: Iterable[tuple[str, str]], path: str) -> None:
    """One file: a JSON header, then the arrays, each at a multiple of 8 bytes."""
    verdicts: dict[str, str] = {}
    for verdict, rule in rules:
        if rule is not None and verdict in ("allow", "block") and (verdict == "block" or rule not in verdicts):
            verdicts[rule] = verdict
    own = sorted((key(r), r) for r in verdicts)
    hosts = sorted((key(h), h) for h in {split_rule(r)[0] for r in verdicts})
    rule_at, rule_heap = _heap([r for _, r in own])
    host_at, host_heap = _heap([h for _, h in hosts])
    arrays = {
        "rule_keys": np.array([k for k, _ in own], dtype=np.uint64), "rule_at": rule_at,
        "rule_heap": np.frombuffer(rule_heap, dtype=np.uint8),
        "block": np.array([verdicts[r] == "block" for _, r in own], dtype=np.uint8),
        "host_keys": np.array([k for k, _ in hosts], dtype=np.uint64), "host_at": host_at,
        "host_heap": np.frombuffer(host_heap, dtype=np.uint8),
        "lengths": np.array(sorted({len(split_rule(r)[1]) for r in verdicts}), dtype=np.int64)}
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    with open(path, "wb") as f:
        f.write(struct.pack("<q", len(text)) + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


class DigestIndex:
    """The mapped file of ``write_index``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n, = struct.unpack("<q", f.read(8))
            head = json.loads(f.read(n))
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        for name, (kind, size, at) in head.items():
            width = np.dtype(kind).itemsize
            setattr(self, name, whole[8 + n + at:8 + n + at + size * width].view(kind))

    @staticmethod
    def _find(keys: np.ndarray, at: np.ndarray, heap: np.ndarray, strings: list[str]) -> np.ndarray:
        """Place of each string in a sorted key array, -1 if it is not there; equal keys are all tried."""
        out = np.full(len(strings), -1, dtype=np.int64)
        if not len(strings) or not len(keys):
            return out
        probe = np.fromiter((key(s) for s in strings), dtype=np.uint64, count=len(strings))
        lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
        for i in np.flatnonzero(lo < hi):
            wanted = strings[i].encode("utf-8", "surrogatepass")
            for j in range(lo[i], hi[i]):
                if heap[at[j]:at[j + 1]].tobytes() == wanted:
                    out[i] = j
                    break
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each URL's longest rule, (None, None) without one."""
        places: dict[str, int] = {}
        owners, suffixes = [], []
        for i, host in enumerate(hosts):
            at = 0
            while at >= 0 and host[at:]:
                suffixes.append(places.setdefault(host[at:], len(places)))
                owners.append(i)
                at = host.find(".", at) + 1 or -1
        names = list(places)
        known = self._find(self.host_keys, self.host_at, self.host_heap, names) >= 0
        tries: dict[str, int] = {}
        wanted = []
        for i, s in zip(owners, suffixes):
            if known[s]:
                for size in self.lengths:
                    if size <= len(paths[i]):
                        wanted.append((i, len(names[s]), tries.setdefault(names[s] + paths[i][:size], len(tries))))
        rules = list(tries)
        found = self._find(self.rule_keys, self.rule_at, self.rule_heap, rules)
        best: dict[int, tuple] = {}
        for i, host_size, t in wanted:
            if found[t] >= 0:
                rank = (len(rules[t]), host_size)
                if i not in best or rank > best[i][0]:
                    best[i] = (rank, rules[t], "block" if self.block[found[t]] else "allow")
        return [best[i][1:] if i in best else (None, None) for i in range(len(hosts))]


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host (A-Z lower-cased) and path of each URL, by built-in functions."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"),
                        F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
                        F.regexp_extract(url, pattern, 2).alias("path"))


_SCHEMA = "host string, path string, rule string, verdict string"


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
          default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. ``rules`` is a list of (verdict, rule), or
    a DataFrame with these columns, which is brought to the driver only below ``MAX_INDEX_BYTES``."""
    spark = pages.sparkSession
    split = parts(pages, id_col, url_col)
    if isinstance(rules, DataFrame):
        held = rules.agg(F.sum(F.length("rule") * 4 + 64)).first()[0] or 0
        if held > MAX_INDEX_BYTES:
            return judge_by_join(split, rules, default)
        rules = [(r["verdict"], r["rule"]) for r in rules.select("verdict", "rule").collect()]
    ship_code(spark)
    name = _ship(spark, rules)
    id_type = split.schema["page_id"].dataType.simpleString()
    cache: dict[str, DigestIndex] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in cache:
            cache[name] = DigestIndex(SparkFiles.get(name))
        for b in batches:
            got = cache[name].judge(b["host"].tolist(), b["path"].tolist())
            b["rule"] = [r for r, _ in got]
            b["verdict"] = [v or default for _, v in got]
            yield b

    return split.mapInPandas(run, f"page_id {id_type}, {_SCHEMA}")


def _ship(spark: SparkSession, rules) -> str:
    """Write the index on the driver; Spark copies it to each executor that runs a task."""
    name = f"url-rules-{uuid.uuid4().hex}.idx"
    path = os.path.join(tempfile.mkdtemp(prefix="url-rules-"), name)
    write_index(rules, path)
    spark.sparkContext.addFile(path)
    return name


def judge_by_join(split: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """The same verdicts for rule sets of any size: the candidates of each distinct (host, path) are
    joined with the rules by key and string. Nothing is sent to the driver."""
    rule = (rules.filter(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block"))
            .groupBy("rule").agg(F.max("verdict").alias("verdict")))  # 'block' is the larger of the two
    rule = rule.select(F.xxhash64("rule").alias("k"), "rule", "verdict")
    urls = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = urls.select("host", "path", F.explode(hosts).alias("s")).filter("s != ''")
    some = some.select("host", "path", "s", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    some = some.select("host", "path", F.length("s").alias("hs"), F.expr("concat(s, left(path, n))").alias("c"))
    some = some.select("host", "path", "hs", "c", F.xxhash64("c").alias("k"))
    hit = some.join(rule, (some.k == rule.k) & (some.c == rule.rule)).groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule"), "hs", "rule", "verdict")).alias("m"))
    out = split.join(hit, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"),
                      F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
