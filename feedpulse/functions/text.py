"""Scalar text and label functions (C1-C12, A9) as Column expressions.

All run inside whole-stage codegen (Java regex, no Python). The character
classes spell out Python's Unicode ``\\s`` so Java and RE2 agree with it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------
# Python's str ``\s``: ASCII white space, the separators U+001C-U+001F, U+0085
# and every Unicode space separator (category Z).
WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}"
# Letters kept by the Vietnamese sentiment cleaner (as the reference spells
# them; it leaves out the letter d with stroke and all digits, Q11).
VI_LETTERS = ("a-zA-Z"
              "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ")
VI_D = "đ"
# Display labels for sentiment predictions.
SENTIMENT_DISPLAY = {"negative": "tiêu cực", "positive": "tích cực", "neutral": "trung tính"}
# Integer sentiment codes of the trend API.
SENTIMENT_CODES = {0: "Negative", 1: "Positive", 2: "Neutral"}
# Keyword fallback used when no trained model is available.
RULE_TOPICS = (("pin", "Battery"), ("ship", "Shipping"))
RULE_TOPIC_OTHER = "Other"
RULE_NEGATIVE_WORD = "yếu"
# Rating range and the value used for a missing or non-finite prediction.
RATING_MIN, RATING_MAX, RATING_FALLBACK = 1.0, 5.0, 3.0
# ----------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_text(c: Column | str, mode: str = "empty") -> Column:
    """Null text -> '' (``mode='empty'``) or the text 'nan' (``mode='nan'``)."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan" if mode == "nan" else ""))


def clean_vi(c: Column | str, keep_d: bool = False) -> Column:
    """Lower-case, keep only the Vietnamese letter class and white space."""
    letters = VI_LETTERS + (VI_D if keep_d else "")
    return F.regexp_replace(F.lower(_c(c)), f"[^{letters}{WS}]", "")


def clean_words(c: Column | str) -> Column:
    """Lower-case, drop everything that is not a word or white-space character."""
    return F.regexp_replace(F.lower(_c(c)), rf"[^\p{{L}}\p{{N}}_{WS}]", "")


def squeeze(c: Column | str) -> Column:
    """Collapse white-space runs to one space, then trim."""
    return F.trim(F.regexp_replace(_c(c), f"[{WS}]+", " "))


def strip_ws(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), f"^[{WS}]+|[{WS}]+$", "")


def clean_basic(c: Column | str) -> Column:
    """C4: lower-case and strip surrounding white space."""
    return strip_ws(F.lower(_c(c)))


def clean_trend(c: Column | str) -> Column:
    """C2 then C3: the cleaner of the trend job and the trend API."""
    return squeeze(clean_words(c))


def full_description(title="title", text="text", name="name", manufacturer="manufacturer",
                     categories="categories") -> Column:
    """The five text fields joined by spaces (null -> ''), lower-case."""
    parts = [null_text(x) for x in (title, text, name, manufacturer, categories)]
    return F.lower(F.concat_ws(" ", *parts))


def spam_target(label: Column | str, mode: str = "strict") -> Column:
    """Spam -> 1; ``strict``: ham -> 0, others null; ``one_vs_rest``: others 0."""
    lab = _c(label)
    if mode == "strict":
        return F.when(lab == "spam", 1).when(lab == "ham", 0).cast("int")
    return F.when(lab == "spam", 1).otherwise(0).cast("int")


def translate_label(c: Column | str, mapping: Mapping[str, str] = SENTIMENT_DISPLAY) -> Column:
    """Dictionary lookup, the value itself when not in the dictionary."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    s = _c(c).cast("string")
    return F.coalesce(F.element_at(m, s), s)


def capitalize(c: Column | str) -> Column:
    s = _c(c).cast("string")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def norm_sentiment(c: Column | str, integral: bool = False) -> Column:
    """Integer code 0/1/2 (others -> Neutral), or text capitalised (first letter only)."""
    if integral:
        m = F.create_map(*[F.lit(x) for kv in SENTIMENT_CODES.items() for x in kv])
        return F.coalesce(F.element_at(m, _c(c).cast("int")), F.lit("Neutral"))
    return capitalize(c)


def rule_topic(clean: Column | str) -> Column:
    """Keyword topic (first keyword contained wins)."""
    x = _c(clean)
    out = F.lit(RULE_TOPIC_OTHER)
    for word, topic in reversed(RULE_TOPICS):
        out = F.when(x.contains(word), F.lit(topic)).otherwise(out)
    return out


def rule_sentiment(clean: Column | str) -> Column:
    """Keyword sentiment."""
    return F.when(_c(clean).contains(RULE_NEGATIVE_WORD), "Negative").otherwise("Positive")


def spam_label(flag: Column | str) -> Column:
    """C11: spam flag -> 'spam' / 'ham'."""
    return F.when(_c(flag), "spam").otherwise("ham")


def is_finite(c: Column | str) -> Column:
    x = _c(c).try_cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clip_rating(c: Column | str, round_to: int | None = None) -> Column:
    """Non-finite, null or no number -> 3.0, else clipped to 1..5; optional rounding."""
    x = _c(c).try_cast("double")
    v = F.when(is_finite(x), F.least(F.greatest(x, F.lit(RATING_MIN)), F.lit(RATING_MAX))) \
         .otherwise(F.lit(RATING_FALLBACK))
    return F.round(v, round_to) if round_to is not None else v


def null_nonfinite(c: Column | str) -> Column:
    """NaN / +-Inf -> null, so results are JSON-safe."""
    x = _c(c)
    return F.when(is_finite(x), x)


def rule_labels(clean: Column | str) -> Column:
    """Keyword (topic, sentiment) as a struct."""
    return F.struct(rule_topic(clean).alias("topic"), rule_sentiment(clean).alias("sentiment"))
