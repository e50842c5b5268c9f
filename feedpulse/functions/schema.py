"""Schema resolution, validation and lenient casts.

Aliases are resolved once against ``df.columns`` on the driver (schema only,
no data), then every row is handled by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The recommender job's alias lists (first present wins; Q3 adds product_id).
RECSYS_ALIASES = {
    "user_id": ["reviews.username", "user_id"],
    "item_id": ["asins", "item_id", "product_id"],
    "rating": ["reviews.rating", "rating"],
    "title": ["reviews.title", "title"],
    "text": ["reviews.text", "text"],
    "name": ["name"],
    "manufacturer": ["manufacturer"],
    "categories": ["categories"],
}
RECSYS_TEXT_DEFAULTS = {"text": "", "title": "", "name": "", "manufacturer": "", "categories": "",
                        "user_id": None, "item_id": None, "rating": None}
# The scoring service's many-to-one rename.
SCORING_RENAME = {
    "reviews.username": "user_id", "username": "user_id",
    "asins": "product_id", "product_id": "product_id", "item_id": "product_id",
    "reviews.title": "title", "title": "title",
    "reviews.text": "text", "text": "text",
}


def first_present(columns: Sequence[str], aliases: Iterable[str], contains: bool = False) -> str | None:
    """B1/B2: the first alias that is a column (or, with ``contains``, a column containing it)."""
    cols = list(columns)
    for a in aliases:
        if contains:
            for c in cols:
                if a in c:
                    return c
        elif a in cols:
            return a
    return None


def resolve(df: DataFrame, targets: Mapping[str, Sequence[str]],
            defaults: Mapping[str, object] | None = None, contains: bool = False,
            keep_others: bool = False) -> DataFrame:
    """Select each target from its first present alias.

    A target with no present alias takes its default (text '' or a null key);
    without a default it is an error listing every missing target.
    """
    defaults = dict(defaults or {})
    exprs: list[Column] = []
    missing = []
    for t, aliases in targets.items():
        src = first_present(df.columns, aliases, contains)
        if src is not None:
            exprs.append(F.col(f"`{src}`").alias(t))
        elif t in defaults:
            v = defaults[t]
            exprs.append((F.lit(v) if v is not None else F.lit(None).cast("string")).alias(t))
        else:
            missing.append(f"{t}: none of {list(aliases)}")
    if missing:
        raise ValueError("missing columns: " + "; ".join(missing))
    if keep_others:
        used = {c for c in df.columns if c not in targets}
        exprs += [F.col(f"`{c}`") for c in df.columns if c in used]
    return df.select(*exprs)


def rename_aliases(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Many-to-one rename; several present aliases of a target are coalesced."""
    groups: dict[str, list[str]] = {}
    for src, dst in mapping.items():
        if src in df.columns:
            groups.setdefault(dst, []).append(src)
    consumed = {s for v in groups.values() for s in v}
    out = [F.col(f"`{c}`") for c in df.columns if c not in consumed and c not in groups]
    for dst, srcs in groups.items():
        cols = ([dst] if dst in df.columns else []) + srcs
        out.append(F.coalesce(*[F.col(f"`{c}`") for c in cols]).alias(dst))
    return df.select(*out)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names."""
    return df.toDF(*[c.lower() for c in df.columns])


def validate(df: DataFrame, required: Mapping[str, Sequence[str]] | Sequence[str],
             name: str = "input", check_empty: bool = True) -> list[str]:
    """All errors at once: missing required columns and an empty input.

    The schema check is driver-side metadata; emptiness is a ``limit(1)`` probe.
    """
    errs = []
    req = required.items() if isinstance(required, Mapping) else [(c, [c]) for c in required]
    for t, aliases in req:
        if first_present(df.columns, aliases) is None:
            errs.append(f"{name}: missing column '{t}'")
    if check_empty and not df.limit(1).take(1):
        errs.append(f"{name}: no rows")
    return errs


# Written dates that are read besides ISO ones, in this order (month before day, as the reference's parser has it).
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy/M/d", "yyyy/M/d H:mm:ss", "yyyyMMdd", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
                "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")


def to_ts(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Lenient timestamp (session zone UTC; ISO text with 'Z', then ``formats``); junk -> null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(F.regexp_replace(c.cast("string"), "Z$", ""))
    eight = s.rlike("^[0-9]{5,}$")  # digits alone are a date written without signs, not a year
    iso = F.when(~eight, F.try_to_timestamp(s))
    return F.coalesce(iso, *[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def dropped_dates(df: DataFrame, date_col: str) -> DataFrame:
    """Rows, and rows whose date text is present but not read (they are dropped by ``drop_null`` of the date)."""
    bad = F.col(date_col).isNotNull() & to_ts(date_col).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_unread_dates"))


def to_num(c: Column | str, fill: float | None = None) -> Column:
    """Lenient double; unparsable -> null, or ``fill`` when given."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.cast("string").try_cast("double")
    return F.coalesce(v, F.lit(float(fill))) if fill is not None else v


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any key column."""
    return df.dropna(subset=list(cols))


def to_flag(c: Column | str) -> Column:
    """``true`` / ``1`` (any case) -> true, everything else false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1"), F.lit(False))


def sufficient(df: DataFrame, label: str, min_rows: int = 3, min_classes: int = 2) -> DataFrame:
    """One row: row count, class count and whether training may proceed."""
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_classes"))
    return a.withColumn("sufficient", (F.col("n_rows") >= min_rows) & (F.col("n_classes") >= min_classes))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
