"""KPI analytics over the trend cube, scored ratings and scored emails.

Inputs use the dashboard's lower-case names:
  trend cube: date, topic, negative, positive, neutral, total_volume
  ratings:    product_id, predicted_rating, [user_id], [date]
  emails:     label, is_spam, [date]

Global scalars (mean, max date, ...) are one-row aggregates attached as
uncorrelated scalar subqueries; nothing is collected to the driver and no
row is paired with another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.operators.ordering import quantile_of_ranks, rank_table
from feedpulse.session import ensure_checkpoint_dir

# Thresholds and sizes of the dashboard rules.
SPIKE_K = 1.5
TOP_NEGATIVE_K = 10
TOP_GROWTH_K = 5
RISKY_BELOW = 3.5
HIGH_RATING = 4.0
POLARISATION_RATING, POLARISATION_NEG = 4.0, 30.0
CRISIS_RATING, CRISIS_NEG = 3.0, 50.0
KDE_GRID, KDE_CUT = 200, 3.0
SPIKE_NOTE = "High Volume Spike"
SPAM_SPIKE_NOTE = "High Spam Volume Spike"


def scalar_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, by one scalar subquery.

    An uncorrelated scalar subquery runs once and is inlined as a value (no join,
    no nested loop); its columns travel together as one struct.
    """
    names = one_row.columns
    one = one_row.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])).scalar()
    with_it = df.withColumn("__one", one)
    return with_it.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__one.c{i}").alias(c) for i, c in enumerate(names)])


# ---------------------------------------------------------------- trend KPIs

def daily_volume(cube: DataFrame, value: str = "total_volume") -> DataFrame:
    """H1: volume per day, ordered by day."""
    return (cube.where(F.col("date").isNotNull())
                .groupBy("date").agg(F.sum(value).alias(value)).orderBy("date"))


def spikes(daily: DataFrame, value: str = "total_volume", k: float = SPIKE_K,
           note: str = SPIKE_NOTE, descending: bool = False) -> DataFrame:
    """H2: days with volume > mean + k * sample std (a null std counts as 0).

    ``daily`` has one row per day, so its statistics are a bounded one-row aggregate.
    """
    stats = daily.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    out = (scalar_join(daily, stats)
           .where(F.col(value) > F.col("__m") + F.lit(k) * F.coalesce(F.col("__s"), F.lit(0.0)))
           .drop("__m", "__s")
           .withColumn("note", F.lit(note)))
    return out.orderBy(F.desc(value), "date") if descending else out.orderBy("date")


def topic_stats(cube: DataFrame) -> DataFrame:
    """H3: per topic sums, negative rate in % and severity = rate x volume."""
    s = cube.groupBy("topic").agg(F.sum("negative").alias("negative"),
                                  F.sum("total_volume").alias("total_volume"),
                                  F.sum("positive").alias("positive"))
    rate = F.when(F.col("total_volume") > 0,
                  F.col("negative") / F.col("total_volume") * 100).otherwise(F.lit(0.0))
    return (s.withColumn("neg_rate", rate)
             .withColumn("severity", F.col("neg_rate") * F.col("total_volume")))


def top_negative(stats: DataFrame, k: int = TOP_NEGATIVE_K) -> DataFrame:
    """H4: the k topics with the highest negative rate (ties by topic)."""
    return stats.orderBy(F.desc("neg_rate"), F.asc("topic")).limit(k)


def topic_growth(cube: DataFrame, k: int | None = TOP_GROWTH_K, days: int = 7) -> DataFrame:
    """H5: volume in the last ``days`` days vs the ``days`` before, per topic.

    Growth is 0 when a topic is missing from either window (Q2); the percent is
    taken against the previous window of the same topic (Q1), 0 when that is 0.
    """
    d = cube.where(F.col("date").isNotNull())
    mx = d.agg(F.max("date").alias("__max"))
    j = scalar_join(d, mx)
    recent_start = F.date_sub(F.col("__max"), days - 1)
    prev_start = F.date_sub(recent_start, days)
    in_recent = F.col("date") >= recent_start
    in_prev = (F.col("date") >= prev_start) & (F.col("date") < recent_start)
    g = (j.groupBy("topic")
          .agg(F.sum(F.when(in_recent, F.col("total_volume"))).alias("__r"),
               F.sum(F.when(in_prev, F.col("total_volume"))).alias("__p"),
               F.count_if(in_recent).alias("__nr"), F.count_if(in_prev).alias("__np"))
          .where((F.col("__nr") > 0) | (F.col("__np") > 0)))
    both = (F.col("__nr") > 0) & (F.col("__np") > 0)
    growth = F.when(both, F.col("__r") - F.col("__p")).otherwise(F.lit(0))
    g = g.withColumn("growth", growth.cast("double"))
    pct = F.when((F.col("__np") > 0) & (F.col("__p") != 0),
                 F.col("growth") / F.abs(F.col("__p")) * 100).otherwise(F.lit(0.0))
    out = g.select("topic", "growth", pct.alias("growth_pct"))
    out = out.orderBy(F.desc("growth_pct"), F.asc("topic"))
    return out.limit(k) if k else out


# ---------------------------------------------------------------- rating KPIs

def product_stats(r: DataFrame, key: str = "product_id", value: str = "predicted_rating") -> DataFrame:
    """H6: mean, count, sample std and % of rows >= 4 per product (one aggregate).

    Rows without a product id form no group (as a dashboard group-by drops them).
    """
    return r.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(value).alias("avg_rating"),
        F.count(value).alias("review_count"),
        F.stddev_samp(value).alias("rating_std"),
        (F.avg(F.when(F.col(value) >= HIGH_RATING, 1.0).otherwise(0.0)) * 100).alias("pct_ge_4"))


def risky_products(stats: DataFrame, below: float = RISKY_BELOW) -> DataFrame:
    """H7: products with mean rating below the threshold, lowest first."""
    return stats.where(F.col("avg_rating") < below).orderBy("avg_rating", stats.columns[0])


def weekly_drift(r: DataFrame, key: str = "product_id", value: str = "predicted_rating") -> DataFrame:
    """H8: % change of each product's mean between the last two weeks present.

    Weeks run Monday..Sunday. A product missing in either week, or with a
    previous mean of 0, gets 0. No rows when fewer than two weeks exist. The two
    weeks are one scalar subquery; the rows are grouped by product once, and nothing is written between.
    """
    d = r.where(F.col("date").isNotNull()).withColumn(
        "__wk", F.date_trunc("week", F.col("date").cast("timestamp")))
    weeks = F.array_sort(F.collect_set("__wk"))  # at most two
    last_two = d.select("__wk").groupBy("__wk").agg(F.lit(1)).orderBy(F.desc("__wk")).limit(2).agg(weeks.alias("w"))
    j = d.withColumn("__w", last_two.scalar()).where(F.size("__w") == 2)

    def mean_of(i):
        return F.avg(F.when(F.col("__wk") == F.get("__w", F.lit(i)), F.col(value)))

    g = j.groupBy(key).agg(mean_of(1).alias("__last"), mean_of(0).alias("__prev"))
    drift = F.when(F.col("__last").isNotNull() & F.col("__prev").isNotNull() & (F.col("__prev") != 0),
                   (F.col("__last") - F.col("__prev")) / F.col("__prev") * 100).otherwise(F.lit(0.0))
    return g.select(key, drift.alias("drift_pct"))


def describe_ratings(r: DataFrame, value: str = "predicted_rating") -> DataFrame:
    """H9: count, mean, sample std, min, quartiles (exact, linear) and max.

    Everything is picked in one aggregate over the table of distinct ratings with their ranks
    (``ordering.rank_table``), so the input is read once.
    """
    t = rank_table(r, value)
    n, gap = F.max("total"), F.col("v") - F.col("mean")
    std = F.when(n > 1, F.sqrt(F.sum(F.col("c") * gap * gap) / (n - 1)))
    names = ("rating_q25", "rating_q50", "rating_q75")
    picks = [quantile_of_ranks(q).alias(name) for q, name in zip((0.25, 0.5, 0.75), names)]
    return t.agg(F.coalesce(n, F.lit(0)).alias("rating_count"), F.max("mean").alias("rating_mean"), std.alias("rating_std"), F.max("lo").alias("rating_min"),
                 *picks, F.max("hi").alias("rating_max"))


def user_volatility(r: DataFrame, user: str = "user_id", value: str = "predicted_rating") -> DataFrame:
    """Mean over users of each user's sample std (users with one rating and rows without a user skipped)."""
    per_user = r.where(F.col(user).isNotNull()).groupBy(user).agg(F.stddev_samp(value).alias("__s"))
    return per_user.agg(F.avg("__s").alias("user_volatility"))


def rating_hist(r: DataFrame, bins: int = 20, value: str = "predicted_rating") -> DataFrame:
    """``bins`` equal-width bins from min to max, last bin closed; empty bins kept. One pass over the rank table."""
    t = rank_table(r.where(~F.isnan(F.col(value).cast("double"))), value)
    same = F.col("lo") == F.col("hi")
    lo, hi = F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi"))
    t = t.select("v", "c", lo.alias("lo"), hi.alias("hi"))
    idx = F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))), F.lit(bins - 1)).cast("int")
    each = t.groupBy(idx.alias("bin")).agg(F.sum("c").alias("count"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))  # a row per bin
    whole = each.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("counts"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = whole.where("lo is not null").select("counts", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                       F.coalesce(F.element_at("counts", F.col("bin")), F.lit(0)).alias("count"))


def rating_kde(r: DataFrame, points: int = KDE_GRID, cut: float = KDE_CUT,
               value: str = "predicted_rating") -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on a ``points`` grid.

    bandwidth h = std * n^(-1/5); grid from min - cut*h to max + cut*h.
    Duplicate values are counted first; each distinct value then adds its
    weighted kernel to every grid point (an array per value, summed per point).
    """
    t = rank_table(r, value)
    gap = F.col("v") - F.col("mean")
    n = F.max("total")
    sd = F.when(n > 1, F.sqrt(F.sum(F.col("c") * gap * gap) / (n - 1)))
    j = scalar_join(t, t.agg((sd * F.pow(n.cast("double"), F.lit(-0.2))).alias("__h")))
    lo, hi = F.col("lo") - F.lit(cut) * F.col("__h"), F.col("hi") + F.lit(cut) * F.col("__h")
    e = j.select("v", "c", F.col("total").alias("__n"), "__h", lo.alias("__g0"), hi.alias("__g1"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__i"))
    step = (F.col("__g1") - F.col("__g0")) / F.lit(float(points - 1))
    gx = F.when(F.col("__i") == points - 1, F.col("__g1")).otherwise(F.col("__g0") + F.col("__i") * step)
    z = (gx - F.col("v")) / F.col("__h")
    g = e.groupBy("__i").agg(F.max(gx).alias("x"), F.sum(F.col("c") * F.exp(F.lit(-0.5) * z * z)).alias("__s"), F.max("__n").alias("__n"), F.max("__h").alias("__h"))
    dens = F.col("__s") / (F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi)))
    return g.select(F.col("__i").alias("point"), "x", dens.alias("density"))


# ---------------------------------------------------------------- email KPIs

def spam_rate(e: DataFrame) -> DataFrame:
    """Emails, spam emails and spam share in %."""
    return e.agg(F.count(F.lit(1)).alias("total_emails"),
                 F.count_if(F.col("is_spam")).alias("spam_count")) \
            .withColumn("spam_rate", F.when(F.col("total_emails") > 0,
                                             F.col("spam_count") / F.col("total_emails") * 100)
                                      .otherwise(F.lit(0.0)))


def spam_daily(e: DataFrame) -> DataFrame:
    """Spam emails per calendar day (Q16: the day, not the raw timestamp)."""
    return (e.where(F.col("is_spam") & F.col("date").isNotNull())
             .groupBy(F.to_date("date").alias("date"))
             .agg(F.count(F.lit(1)).alias("spam_volume")).orderBy("date"))


def spam_spikes(e: DataFrame, k: float = SPIKE_K) -> DataFrame:
    """Days whose spam volume exceeds mean + k * std."""
    return spikes(spam_daily(e), "spam_volume", k, SPAM_SPIKE_NOTE)


def label_share(e: DataFrame, label: str = "label") -> DataFrame:
    """Share of each label in % (1 decimal) and the most frequent label flag.

    The total and the top label (largest count, ties by label) are scalar
    subqueries over the per-label counts.
    """
    c = e.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n")).scalar()
    top = c.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label")))).scalar()
    return c.select("label", "n", F.round(F.col("n") / tot * 100, 1).alias("pct"), (F.col("label") == top).alias("is_top"))


def top_n_others(share: DataFrame, n: int = 5, value: str = "pct") -> DataFrame:
    """The n largest labels (ties by label), the rest summed into ``Others`` (kept when > 0)."""
    s = share.select("label", F.col(value).cast("double").alias(value))
    top = s.orderBy(F.desc(value), F.asc("label")).limit(n)
    rest = (s.join(top.select("label"), "label", "left_anti").agg(F.sum(value).alias(value))
              .where(F.col(value) > 0).select(F.lit("Others").alias("label"), value))
    return top.unionByName(rest)


def email_daily(e: DataFrame) -> DataFrame:
    """Emails per day."""
    return e.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("count"))


def label_counts(e: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label."""
    return e.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def count_label(e: DataFrame, value: str = "complaint", label: str = "label") -> DataFrame:
    """Rows whose label equals ``value`` case-insensitively, and whether any exist."""
    return e.agg(F.count_if(F.lower(F.col(label)) == value).alias("label_count")) \
            .withColumn("present", F.col("label_count") > 0)


# ---------------------------------------------------------------- cross KPIs

def overall(r: DataFrame, cube: DataFrame, value: str = "predicted_rating") -> DataFrame:
    """Mean rating, negative rate % and total volume (at least 1)."""
    return _with_cube(r.agg(F.avg(value).alias("avg_rating")), cube)


def _with_cube(a: DataFrame, cube: DataFrame) -> DataFrame:
    b = cube.agg(F.sum("negative").alias("total_negative"),
                 F.greatest(F.coalesce(F.sum("total_volume"), F.lit(0)), F.lit(1)).alias("total_volume"))
    return scalar_join(a, b).withColumn(
        "avg_neg_rate", F.col("total_negative") / F.col("total_volume") * 100)


def _fmt(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", c)


def insights(r: DataFrame, cube: DataFrame, e: DataFrame | None = None,
             with_stable: bool = False) -> DataFrame:
    """Rule-based insights as rows ``(rule, severity, message)``.

    Each rule is a small DataFrame built from the KPI tables above; the lists it
    quotes (spike days, risky products) are bounded by days / top-5.
    """
    # every rule works on two small tables, each computed once from its input: the cube and one row per product
    ensure_checkpoint_dir(r.sparkSession)
    cube = cube.checkpoint(eager=True)
    per = r.groupBy("product_id").agg(F.sum("predicted_rating").alias("__s"), F.count("predicted_rating").alias("__n"))
    per = per.checkpoint(eager=True)
    n = F.sum("__n")
    ov = _with_cube(per.agg(F.when(n > 0, F.sum("__s") / n).alias("avg_rating")), cube)
    rules = [
        ov.select(F.lit("avg_rating").alias("rule"), F.lit("info").alias("severity"),
                  F.concat(F.lit("mean rating "), _fmt(F.col("avg_rating"), 2), F.lit("/5")).alias("message")),
        ov.select(F.lit("neg_rate").alias("rule"), F.lit("info").alias("severity"),
                  F.concat(F.lit("mean negative rate "), _fmt(F.col("avg_neg_rate")), F.lit("%")).alias("message")),
        ov.select(F.lit("volume").alias("rule"), F.lit("info").alias("severity"),
                  F.concat(F.lit("total volume "), F.col("total_volume").cast("bigint").cast("string")).alias("message")),
    ]
    pol = (F.col("avg_rating") > POLARISATION_RATING) & (F.col("avg_neg_rate") > POLARISATION_NEG)
    cri = (F.col("avg_rating") < CRISIS_RATING) & (F.col("avg_neg_rate") > CRISIS_NEG)
    rules.append(ov.where(pol).select(F.lit("polarisation").alias("rule"), F.lit("warning").alias("severity"),
                                      F.lit("high rating but much negative discussion").alias("message")))
    crisis = ov.where(cri)
    if with_stable:
        crisis = crisis.where(~pol)
    rules.append(crisis.select(F.lit("crisis").alias("rule"), F.lit("critical").alias("severity"),
                               F.lit("low rating and strongly negative discussion").alias("message")))
    if with_stable:
        rules.append(ov.where(~pol & ~cri).select(F.lit("stable").alias("rule"), F.lit("info").alias("severity"),
                                                  F.lit("rating and sentiment agree").alias("message")))
    sp = spikes(daily_volume(cube))
    rules.append(sp.agg(F.count(F.lit(1)).alias("__n"),
                        F.array_join(F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd"))), ", ").alias("__d"))
                   .where(F.col("__n") > 0)
                   .select(F.lit("spike").alias("rule"), F.lit("warning").alias("severity"),
                           F.concat(F.lit("volume spike on "), F.col("__d")).alias("message")))
    worst = top_negative(topic_stats(cube), 1)
    rules.append(worst.select(F.lit("worst_topic").alias("rule"), F.lit("warning").alias("severity"),
                              F.concat(F.lit("most negative topic "), F.col("topic"), F.lit(" ("),
                                       _fmt(F.col("neg_rate")), F.lit("%)")).alias("message")))
    means = per.where(F.col("product_id").isNotNull() & (F.col("__n") > 0)).select(
        "product_id", (F.col("__s") / F.col("__n")).alias("avg_rating"))
    risky = risky_products(means).limit(5)
    rules.append(risky.agg(F.count(F.lit(1)).alias("__n"),
                           F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("avg_rating", "product_id"))),
                                                    lambda s: s["product_id"].cast("string")), ", ").alias("__p"))
                      .where(F.col("__n") > 0)
                      .select(F.lit("risky_products").alias("rule"), F.lit("critical").alias("severity"),
                              F.concat(F.lit("products to check: "), F.col("__p")).alias("message")))
    gr = topic_growth(cube, 1)
    rules.append(gr.select(F.lit("growth").alias("rule"), F.lit("info").alias("severity"),
                           F.concat(F.lit("fastest growing topic "), F.col("topic"), F.lit(" ("),
                                    _fmt(F.col("growth_pct")), F.lit("%)")).alias("message")))
    if e is not None and "is_spam" in e.columns:
        rules.append(spam_rate(e).select(F.lit("spam_rate").alias("rule"), F.lit("info").alias("severity"),
                                         F.concat(F.lit("spam share "), _fmt(F.col("spam_rate")), F.lit("%")).alias("message")))
    if e is not None and "label" in e.columns:
        top = label_share(e).where("is_top")
        rules.append(top.select(F.lit("top_label").alias("rule"), F.lit("info").alias("severity"),
                                F.concat(F.lit("most frequent label "), F.col("label"), F.lit(" ("),
                                         _fmt(F.col("pct")), F.lit("%)")).alias("message")))
    out = rules[0]
    for x in rules[1:]:
        out = out.unionByName(x)
    return out


def sentiment_stats(fb: DataFrame, date_from: str | None = None, date_to: str | None = None,
                    product: str | None = None) -> DataFrame:
    """Sentiment counts and shares for a date range and optional product/topic."""
    d = fb
    if date_from:
        d = d.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        d = d.where(F.col("date") <= F.lit(date_to).cast("date"))
    if product:
        d = d.where(F.col("topic") == product)
    a = d.agg(F.count(F.lit(1)).alias("total"),
              F.count_if(F.col("sentiment") == "Negative").alias("negative"),
              F.count_if(F.col("sentiment") == "Positive").alias("positive"),
              F.count_if(F.col("sentiment") == "Neutral").alias("neutral"))
    return a.withColumn("negative_pct", F.when(F.col("total") > 0, F.col("negative") / F.col("total") * 100)
                                          .otherwise(F.lit(0.0)))


def top_negative_reviews(df: DataFrame, k: int = 10, score: str = "confidence",
                         ascending: bool = False, key: str = "id") -> DataFrame:
    """The k negative rows with the strongest score (top-k, ties by key)."""
    o = F.asc(score) if ascending else F.desc(score)
    return df.where(F.lower(F.col("sentiment")) == "negative").orderBy(o, F.asc(key)).limit(k)


# ---------------------------------------------------------------- dashboard composition

def email_kpis(e: DataFrame) -> dict[str, DataFrame]:
    """Email KPIs of an uploaded frame: spam rate and label shares always; the daily spam
    volume and spam spikes only when a date-like column exists (Q17)."""
    from feedpulse.functions import schema as S
    e = S.normalize_columns(e)
    out: dict[str, DataFrame] = {}
    date_src = S.first_present(e.columns, ("date", "timestamp"), contains=True)
    if date_src is not None:
        e = S.drop_null(e.withColumn("date", S.to_ts(F.col(f"`{date_src}`"))), ["date"])
    if "is_spam" in e.columns:
        e = e.withColumn("is_spam", S.to_flag("is_spam"))
        out["spam_rate"] = spam_rate(e)
        if date_src is not None:
            out["spam_daily"] = spam_daily(e)
            out["spam_spikes"] = spam_spikes(e)
    if "label" in e.columns:
        out["label_share"] = label_share(e)
        out["label_top5"] = top_n_others(out["label_share"], 5)
    return out


def dashboard(ratings: DataFrame, cube: DataFrame, emails: DataFrame | None = None) -> dict[str, DataFrame]:
    """The KPI dashboard: trend, rating and email KPIs plus rule insights, one DataFrame each.

    Inputs use the dashboard's column names in any case (they are lower-cased);
    numeric columns are cast leniently (B8) and dates parsed leniently (B7).
    """
    from feedpulse.functions import schema as S
    cube = S.normalize_columns(cube)
    cube = cube.select(S.to_ts("date").cast("date").alias("date"), F.col("topic").cast("string").alias("topic"),
                       *[S.to_num(c, 0.0).alias(c) for c in ("negative", "positive", "neutral", "total_volume")
                         if c in cube.columns])
    for c in ("negative", "positive", "neutral"):
        if c not in cube.columns:
            cube = cube.withColumn(c, F.lit(0.0))
    ratings = S.normalize_columns(ratings)
    ratings = ratings.withColumn("predicted_rating", S.to_num("predicted_rating"))
    if "user_id" in ratings.columns:
        ratings = ratings.withColumn("user_id", F.col("user_id").cast("string"))
    daily = daily_volume(cube)
    stats = topic_stats(cube)
    out = {"daily_volume": daily, "spikes": spikes(daily), "topic_stats": stats, "top_negative": top_negative(stats),
           "topic_growth": topic_growth(cube), "product_stats": product_stats(ratings),
           "risky_products": risky_products(product_stats(ratings)), "overall": overall(ratings, cube),
           "rating_hist": rating_hist(ratings), "rating_kde": rating_kde(ratings)}
    if emails is not None:
        out.update(email_kpis(emails))
    out["insights"] = insights(ratings, cube, S.normalize_columns(emails).withColumn(
        "is_spam", S.to_flag("is_spam")) if emails is not None and "is_spam" in [c.lower() for c in emails.columns]
        else None)
    return out
