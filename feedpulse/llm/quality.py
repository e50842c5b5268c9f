"""Operator 10, quality rules: a rule bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one
``fail_bits`` number whose bit i is set when rule i fails. A policy is a version name and a
mask of the rules that it enforces: applying another version, or asking what a policy would
keep without one of its rules, reads the ledger and never the texts.

Defined results: a null or empty text has no words (all measurements 0, fails ``few_words``);
a null doc_id is kept as a row of its own; repeated rows are judged one by one; an empty table
gives an empty ledger; other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import SPACE, SPACE_CHARS, free_name

WINDOW = 8

# (name, failure condition over the measurements); the bit of a rule is its place here.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask("few_words", "repeated_windows")
# versioned policies: the rules that each enforces
POLICIES = {
    "v1": BASE,
    "v2": BASE | mask("symbols", "dup_lines", "upper_case", "long_words"),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though ``body`` uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(h: Column, shift: int, n: Column) -> Column:
    """Each element hashed together with the one ``shift`` places on."""
    return _let(h, lambda a: F.zip_with(a, F.slice(a, F.lit(shift + 1), F.greatest(n, F.lit(1))),
                                        lambda x, y: F.xxhash64(x, y)))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash is found twice or more: sort (hash, place), take the places
    whose neighbour has the same hash, then add up the union of their intervals."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("sum"))
    return F.aggregate(
        _let(placed, places), start,
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")),
        lambda a: a["sum"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """One row per document with its measurements, in one pass over the texts and without a shuffle.
    ``keep`` is one more column to carry along (as ``kept_row``)."""
    carried = [] if keep is None else [F.col("kept_row")]
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                    *([] if keep is None else [keep.alias("kept_row")]))
    d = d.select("doc_id", "t", F.btrim("t", F.lit(SPACE_CHARS)).alias("b"), *carried)
    d = d.select("doc_id", "t", F.when(F.length("b") == 0, F.array().cast("array<string>"))
                 .otherwise(F.split("b", SPACE + "+")).alias("w"), *carried)
    d = d.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"), *carried)
    size = F.col("n_words").cast("int")
    d = d.withColumn("h", F.when(size >= WINDOW, F.slice(
        _pairs(_pairs(_pairs(F.col("h"), 1, size), 2, size), 4, size),
        F.lit(1), F.greatest(size - WINDOW + 1, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("h") == F.size(F.array_distinct("h")), F.lit(0).cast("bigint"))
         .otherwise(_covered(F.col("h"))).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"), "n_upper", *carried)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """Measurements plus ``fail_bits``: every rule is evaluated once."""
    bits = F.lit(0).cast("bigint")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, id_col, text_col, keep).withColumn("fail_bits", bits)


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("bigint")) == 0


def apply_policy(led: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` of one policy version."""
    return (led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("bigint")) != 0)
               .withColumn("kept", passes(policy)))


def ablations(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else (so come back without
    it), and documents kept with the policy. Documents are first counted by their bits, so all
    further work is on at most 2^rules rows."""
    m = POLICIES[policy]
    bits = F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint"))
    counts = led.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("bigint").alias("bit"))
                      for n, _ in RULES if m & BIT[n]])
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (counts.select("bits", "n", F.explode(names).alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
                 F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept")))


def keep_documents(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    name = free_name(docs.columns, "doc_row")
    led = ledger(docs, keep=F.struct(*[F.col(f"`{c}`") for c in docs.columns])) if docs.columns else docs
    # the bits pass through a generator: a filter on them would else be pushed below the projections, where
    # each use of a measurement computes it again
    judged = led.select(F.col("kept_row").alias(name), F.explode(F.array("fail_bits")).alias("bits"))
    return judged.filter(passes(policy, "bits")).select(f"{name}.*")
