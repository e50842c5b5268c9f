"""Canonical input views built from the given tables.

Each view is a lazy DataFrame over the Parquet scans, so filters and column
pruning of the operators above reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedpulse.operators.ordering import running_count
from feedpulse.sources.tables import table

# Sentiment bands on events.value, and the day 0 of day_no.
NEGATIVE_BELOW = 10
POSITIVE_BELOW = 100
DAY_ZERO = "2024-01-01"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classified comment per row: id, date, topic, sentiment, user_id, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("topic"),
        F.when(F.col("value") < NEGATIVE_BELOW, "Negative")
         .when(F.col("value") < POSITIVE_BELOW, "Positive")
         .otherwise("Neutral").alias("sentiment"),
        "user_id", "value")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text: doc_id, text, topic, label, day_no."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id")
             .select("doc_id", "text", F.col("source").alias("topic"),
                     F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("label"),
                     (F.col("doc_id") % 30).cast("int").alias("day_no")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, text, topic, day_no (operators that need no label read this)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("topic"), (F.col("doc_id") % 30).cast("int").alias("day_no"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated products: one row per line item with user, item, rating and text fields."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                      F.col("o_custkey").cast("string").alias("user_id"),
                      F.col("l_partkey").cast("string").alias("item_id"),
                      (1 + (F.col("l_quantity").cast("int") - 1) % 5).alias("rating"),
                      F.col("o_orderdate").cast("date").alias("date"),
                      F.col("o_orderpriority").alias("title"),
                      F.col("p_name").alias("name"),
                      F.col("p_brand").alias("manufacturer"),
                      F.col("p_type").alias("categories")))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spam-labelled messages: conv_id, turn, text, label, is_spam, day_no."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", "text",
        F.when(F.col("role") == "system", "spam")
         .when(F.col("role") == "user", "ham").otherwise("support").alias("label"),
        (F.col("role") == "system").alias("is_spam"),
        (F.col("conv_id") % 30).cast("int").alias("day_no"))


def day_from_no(c) -> "F.Column":
    return F.date_add(F.lit(DAY_ZERO).cast("date"), c)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone counters per event_type with one reset after day 15.

    ``value`` is the running count of the series; it is numbered per sampled
    time slice plus an offset so that no task sorts a whole series.
    """
    e = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id",
        (F.dayofmonth("ts") > 15).alias("after_restart"))
    out = running_count(e, ["event_type", "after_restart"], ["ts", "event_id"], out="value")
    return out.select("ts", "event_type", "after_restart", F.col("value").cast("bigint").alias("value"))


VIEW_SQL = {
    "feedback": f"""select event_id as id, cast(ts as date) as date, event_type as topic,
       case when value < {NEGATIVE_BELOW} then 'Negative' when value < {POSITIVE_BELOW} then 'Positive'
            else 'Neutral' end as sentiment, user_id, value from events""",
    "reviews": """select d.doc_id, d.text, d.source as topic,
       case when l.toxic = 1 then 'negative' else 'positive' end as label,
       cast(d.doc_id % 30 as int) as day_no
       from documents d join labels l on d.doc_id = l.doc_id""",
    "texts": "select doc_id, text, source as topic, cast(doc_id % 30 as int) as day_no from documents",
    "interactions": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       cast(o_custkey as varchar) as user_id, cast(l_partkey as varchar) as item_id,
       1 + (cast(l_quantity as int) - 1) % 5 as rating, cast(o_orderdate as date) as date,
       o_orderpriority as title, p_name as name, p_brand as manufacturer, p_type as categories
       from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "emails": """select conv_id, turn, text,
       case role when 'system' then 'spam' when 'user' then 'ham' else 'support' end as label,
       role = 'system' as is_spam, cast(conv_id % 30 as int) as day_no from conversations""",
    "samples": """select ts, event_type, day(ts) > 15 as after_restart,
       count(*) over (partition by event_type, day(ts) > 15 order by ts, event_id
                      rows between unbounded preceding and current row) as value from events""",
}


VIEW_DEPS: dict[str, tuple[str, ...]] = {}


def add_view_sql(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    """Declare a derived oracle view (a CTE over the canonical views)."""
    VIEW_SQL[name] = sql
    VIEW_DEPS[name] = tuple(deps)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the views it uses (and their dependencies) as CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEW_DEPS.get(n, ()):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in order)
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{sql}"
