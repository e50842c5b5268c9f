"""Operator 11: secret scans in native expressions.

``scan`` finds secrets in every text and returns their spans. Three base rules are plain patterns
(assignments to a secret's name, access keys, long hex runs). The method adds spans: strings of one
character class (``CLASSES``) are candidates, a window slides over each, and the window's Shannon
entropy is kept by counts that change by one with each character that leaves or enters. Windows with
at least the class's bits per character are secret; overlapping ones make one span. Candidates that an
allow-list names (identifiers, UUIDs, placeholders), or that follow a word of ``ALLOW_BEFORE``
(checksums, inline images), are suppressed; base spans never are.

Everything happens inside a row, so nothing is shuffled and a lost task is simply run again. Entropy
is summed in whole millionths of a bit, so that it has no rounding drift. Candidates are folded in
blocks of ``BLOCK`` characters that overlap by a window less one, so memory does not grow with their length.

Defined results: a null text is empty; an empty text has no spans; very long texts are scanned whole;
equal rows get equal results; rows with null ids are kept; an empty table gives an empty table; columns
of the input keep their names, and the result column takes underscores if its name is taken.
Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import free_name

# The base rules, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """A character class: its letters, the width of the window, and the least bits per character."""

    kind: str
    letters: str
    window: int
    bits: float


_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Random strings of these classes have about 3.4, 3.6 and 4.2 bits in such windows; long words have 3.2.
CLASSES = (CharClass("entropy_hex", _DIGITS + "abcdefABCDEF", 24, 3.1),
           CharClass("entropy_upper", _DIGITS + _UPPER, 20, 3.4),
           CharClass("entropy_base64", _DIGITS + _UPPER + _UPPER.lower() + "+/_=-", 24, 3.9))

# Candidates that are no secrets, and what stands before strings that are none.
ALLOW = (r"^[A-Za-z]+([-_/=+]+[A-Za-z]*)*$",  # words, identifiers and paths without digits
         r"^[0-9+/_=-]+$",  # numbers and dates
         r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUIDs
         r"(?i)example|sample|placeholder|changeme|dummy|redacted",
         r"(?i)abcdefghij|0123456789|qwertyuiop")
ALLOW_BEFORE = (r"(?i)(sha-?(1|224|256|384|512)|md5|integrity|checksum|digest|etag)[\"'\x20:=-]*$",
                r"(?i);base64,$")
CONTEXT = 40  # characters before a candidate in which ALLOW_BEFORE looks
UNIT = 10 ** 6  # entropy is counted in millionths of a bit
BLOCK = 4096
_CHUNK = 256

_SPAN = "struct<start:int,end:int>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column, size: int) -> Column:
    """The array cut into arrays of ``size`` elements; an empty one stays one empty chunk."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * size + 1, size))


def locate(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, hit, before), ``before`` being the text
    since the match before. Lengths are summed in chunks, so the work stays linear in the matches."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def local(chunk: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,hit:string,before:string>>").alias("out"))
        return F.aggregate(chunk, zero, lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(F.coalesce(x["hit"], F.lit("")))).alias("at"),
            F.when(x["hit"].isNull(), a["out"]).otherwise(F.array_append(a["out"], F.struct(
                (a["at"] + F.length(x["gap"])).alias("start"), x["hit"].alias("hit"), x["gap"].alias("before")))).alias("out")))

    def joined(runs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offs"))
        offs = F.aggregate(runs, zero, lambda a, r: F.struct(
            (a["at"] + r["at"]).alias("at"), F.array_append(a["offs"], a["at"]).alias("offs")), lambda a: a["offs"])
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), offs.alias("off")), lambda z: F.transform(
            z["run"]["out"], lambda s: F.struct((s["start"] + z["off"]).alias("start"), s["hit"].alias("hit"), s["before"].alias("before")))))

    found = _bound(parts, lambda z: _bound(F.transform(_chunks(z, _CHUNK), local), joined))
    none = F.array().cast("array<struct<start:int,hit:string,before:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the base rules: array of (start, end, ord, kind)."""

    def spans(i: int, pattern: str, passes) -> Column:
        return F.transform(F.filter(locate(text, pattern), lambda m: passes(m["hit"])), lambda m: _span(
            m["start"], m["start"] + F.length(m["hit"]), i, BASE_KINDS[i]))

    return F.concat(
        spans(0, ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_MIN),
        spans(1, ACCESS, lambda h: F.length(h) >= ACCESS_MIN),
        # the runs of 32 and more are those runs of any length that pass
        spans(2, HEX[:-1] + "{%d,}" % HEX_MIN, lambda h: F.lit(True)))


def _span(start: Column, end: Column, order: int, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"),
                    F.lit(order).alias("ord"), F.lit(kind).alias("kind"))


def _merged(spans: Column) -> Column:
    """Ordered (start, end) spans with those that touch or overlap made one."""
    zero = F.struct(F.array().cast(f"array<{_SPAN}>").alias("out"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        F.when((a["hi"] < 0) | (s["start"] <= a["hi"]), a["out"]).otherwise(
            F.array_append(a["out"], F.struct(a["lo"].alias("start"), a["hi"].alias("end")))).alias("out"),
        F.when((a["hi"] >= 0) & (s["start"] <= a["hi"]), a["lo"]).otherwise(s["start"]).alias("lo"),
        F.when(s["start"] <= a["hi"], F.greatest(a["hi"], s["end"])).otherwise(s["end"]).alias("hi")),
        lambda a: F.when(a["hi"] < 0, a["out"]).otherwise(
            F.array_append(a["out"], F.struct(a["lo"].alias("start"), a["hi"].alias("end")))))


def weights(window: int) -> list[int]:
    """c * log2(c) in millionths, for counts 0 to ``window``: a window's entropy is
    log2(window) - (sum of these over its counts) / window."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def limit(c: CharClass) -> int:
    """The largest sum of weights that still has ``c.bits`` bits per character."""
    return math.floor(c.window * (math.log2(c.window) - c.bits) * UNIT)


def _hot_windows(block: Column, c: CharClass) -> Column:
    """Spans of a block's windows of enough entropy, by counts that change by one per event: a
    character leaves the window, the next one enters."""
    w, table, most = c.window, F.array(*[F.lit(x) for x in weights(c.window)]), F.lit(limit(c))
    index = F.transform(F.split(block, "", -1), lambda ch: F.position(ch, F.lit(c.letters)))
    index = F.filter(index, lambda i: i > 0)  # split may leave an empty last element
    gone = lambda ix: F.slice(F.concat(F.array_repeat(F.lit(0), w), ix), 1, F.size(ix))
    events = _bound(index, lambda ix: F.flatten(F.transform(
        F.arrays_zip(ix.alias("come"), gone(ix).alias("gone")),
        lambda z: F.array(F.struct(z["gone"].alias("at"), F.lit(-1).alias("step")),
                          F.struct(z["come"].alias("at"), F.lit(1).alias("step"))))))
    zero = F.struct(F.array_repeat(F.lit(0), len(c.letters)).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("seen"),
                    F.array().cast(f"array<{_SPAN}>").alias("out"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def step(a: Column, e: Column) -> Column:
        at, by = e["at"], e["step"]
        n = F.get(a["counts"], at - 1)
        counts = F.when(at == 0, a["counts"]).otherwise(F.concat(
            F.slice(a["counts"], F.lit(1), at - 1), F.array(n + by), F.slice(a["counts"], at + 1, F.lit(len(c.letters)))))
        total = F.when(at == 0, a["sum"]).otherwise(a["sum"] + F.get(table, n + by) - F.get(table, n))
        seen = a["seen"] + F.when(by > 0, 1).otherwise(0)
        hot = (by > 0) & (seen >= w) & (total <= most)
        joins = hot & (a["hi"] >= seen - w)
        return F.struct(
            counts.alias("counts"), total.alias("sum"), seen.alias("seen"),
            F.when(hot & ~joins & (a["hi"] >= 0), F.array_append(a["out"], F.struct(a["lo"].alias("start"), a["hi"].alias("end"))))
             .otherwise(a["out"]).alias("out"),
            F.when(hot & ~joins, seen - w).otherwise(a["lo"]).alias("lo"),
            F.when(hot, seen).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(events, zero, step, lambda a: F.when(a["hi"] < 0, a["out"]).otherwise(
        F.array_append(a["out"], F.struct(a["lo"].alias("start"), a["hi"].alias("end")))))


def entropy_spans(text: Column, c: CharClass, order: int, allow: Sequence[str] = ALLOW,
                  allow_before: Sequence[str] = ALLOW_BEFORE) -> Column:
    """Spans of one character class: array of (start, end, ord, kind)."""
    letters = "".join("\\" + x if x in "-]\\^" else x for x in c.letters)
    runs = locate(text, "[%s]{%d,}" % (letters, c.window))

    def secret(m: Column) -> Column:
        ok = F.lit(True)
        for p in allow:
            ok = ok & ~m["hit"].rlike(p)
        for p in allow_before:
            ok = ok & ~F.right(m["before"], F.lit(CONTEXT)).rlike(p)
        return ok

    stride = BLOCK - c.window + 1

    def spans(m: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(m["hit"]) - c.window, F.lit(stride))
        hot = F.flatten(F.transform(starts, lambda s: F.transform(
            _hot_windows(F.substring(m["hit"], s + 1, F.lit(BLOCK)), c),
            lambda x: F.struct((x["start"] + s).alias("start"), (x["end"] + s).alias("end")))))
        return F.transform(_merged(hot), lambda x: _span(m["start"] + x["start"], m["start"] + x["end"], order, c.kind))

    return F.flatten(F.transform(F.filter(runs, secret), spans))


def scan(df: DataFrame, text_col: str = "text", classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW,
         allow_before: Sequence[str] = ALLOW_BEFORE, out: str = "spans") -> DataFrame:
    """The rows with an array of (start, end, ord, kind) of all spans, by start, then by kind as
    listed: the base kinds first (``ord`` below 3), then the classes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = [base_spans(text)] + [entropy_spans(text, c, len(BASE_KINDS) + i, allow, allow_before) for i, c in enumerate(classes)]
    by = lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"])
    ordered = F.transform(F.array_sort(F.transform(F.concat(*found), by)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["ord"].alias("ord"), s["kind"].alias("kind")))
    return df.withColumn(free_name(df.columns, out), ordered)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """The rows with every span of their text replaced by ``mask``; spans that touch share one mask."""
    name = free_name(df.columns, "spans")
    found = scan(df, text_col, out=name, **options)
    text = F.col(text_col)
    whole = _merged(F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def cut(spans: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        ends = F.array_append(F.transform(spans, lambda s: s["start"]), F.length(text))
        return F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                                        lambda z: F.substring(text, z["a"] + 1, z["b"] - z["a"])), mask)

    clean = F.when(F.size(name) == 0, text).otherwise(_bound(whole, cut))
    return found.withColumn(text_col, clean).drop(name)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, and all spans as a string."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
