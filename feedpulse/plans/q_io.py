"""Registered source / sink round trips (A1-A8, A10, A11) over the given tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedpulse.functions.schema import normalize_columns
from feedpulse.operators.trend import trend_daily
from feedpulse.plans.registry import register
from feedpulse.plans.views import feedback, with_views
from feedpulse.session import scratch_path
from feedpulse.sources import io as IO
from feedpulse.sources.tables import table

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])


def _dir(spark, sf, name):
    return scratch_path(spark, f"io/{name}/{hashlib.md5(sf.encode()).hexdigest()[:8]}")


@register("csv_roundtrip", "select doc_id, text, lang, source, n_chars from documents")
def q_csv_roundtrip(spark, sf):
    d = _dir(spark, sf, "csv_roundtrip")
    IO.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), d)
    return IO.read_csv_folder(spark, d, DOC_SCHEMA, multi_line=True)  # texts hold line breaks


@register("csv_union_by_name", """select doc_id, text, lang, source,
    case when lang in ('en', 'fr') then n_chars end as n_chars from documents""")
def q_csv_union(spark, sf):
    d = _dir(spark, sf, "csv_union")
    docs = table(spark, sf, "documents")
    a = docs.where(F.col("lang").isin("en", "fr")).select("doc_id", "text", "lang", "source", "n_chars")
    b = docs.where(~F.col("lang").isin("en", "fr")).select("source", "lang", "doc_id", "text")
    IO.write_csv(a, f"{d}/part_a")
    IO.write_csv(b, f"{d}/part_b")
    # both writers' files end up in one folder listing via a glob over the two sub-folders
    return IO.read_csv_folder(spark, d, DOC_SCHEMA, pattern="part_*/*.csv", multi_line=True)


@register("csv_column_subset", "select text, source from documents")
def q_csv_subset(spark, sf):
    d = _dir(spark, sf, "csv_roundtrip_subset")
    IO.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), d)
    return IO.read_csv_folder(spark, d, DOC_SCHEMA, columns=["text", "source"], multi_line=True)


_CUBE = """select date, topic,
  count(*) filter (where sentiment = 'Negative') as negative,
  count(*) filter (where sentiment = 'Positive') as positive,
  count(*) filter (where sentiment = 'Neutral') as neutral,
  count(*) as total_volume,
  count(*) filter (where sentiment = 'Negative') / count(*) as negative_rate
  from feedback where date is not null group by date, topic"""


@register("parquet_zone_roundtrip", with_views(_CUBE, "feedback"))
def q_zone(spark, sf):
    d = _dir(spark, sf, "zone")
    IO.write_zone(normalize_columns(trend_daily(feedback(spark, sf))), d)
    return IO.read_zone(spark, d)


@register("read_any", "select event_type, count(*) as n from events group by event_type")
def q_read_any(spark, sf):
    return IO.read_any(spark, f"{sf}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("gold_partition_overwrite", with_views(_CUBE, "feedback"))
def q_gold(spark, sf):
    d = _dir(spark, sf, "gold")
    cube = normalize_columns(trend_daily(feedback(spark, sf)))
    # first run writes every day with zeroed counts, the second rewrites each day it carries
    IO.write_gold(cube.withColumn("negative", F.lit(0).cast("bigint")), d)
    IO.write_gold(cube, d)
    return IO.read_zone(spark, d).select("date", "topic", "negative", "positive", "neutral", "total_volume",
                                         "negative_rate")


@register("batch_summary", "select count(*) as total_rows, count(distinct cast(ts as date)) as total_days from events")
def q_batch_summary(spark, sf):
    return IO.batch_summary(table(spark, sf, "events"), "ts")


@register("latin1_fallback", """select doc_id,
    case when lang = 'fr' then regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') else text end as text,
    lang, source, n_chars from documents""")
def q_latin1(spark, sf):
    """A Latin-1 written copy and a UTF-8 copy of the documents read back with detected encodings."""
    d = _dir(spark, sf, "latin1")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    IO.write_csv(docs.where(F.col("lang") == "fr"), f"{d}/latin", encoding="ISO-8859-1")
    IO.write_csv(docs.where(F.col("lang") != "fr"), f"{d}/utf8")
    parts = [IO.read_csv_any_encoding(spark, f"{d}/{sub}", DOC_SCHEMA, multi_line=True) for sub in ("latin", "utf8")]
    return IO.union_by_name(parts)


@register("rejected_files", """select lang, lang in ('fr', 'es', 'de') as rejected,
    case when lang in ('fr', 'es') then 'header is not UTF-8 text' when lang = 'de' then 'a line below the header is not UTF-8 text' end as reason,
    case when lang in ('fr', 'es', 'de') then count(*) filter (where lang = 'de') + cast(lang in ('fr', 'es') as int) end as bad_lines,
    count(*) as n_rows from documents group by lang""")
def q_rejected_files(spark, sf):
    """A3: one CSV per language; two of them get a header that is no UTF-8 text, one gets such lines below it. They are listed, the others are read."""
    d = _dir(spark, sf, "rejected")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    langs = [r["lang"] for r in docs.select("lang").distinct().collect()]  # a handful
    for lang in langs:
        bad = lang in ("fr", "es")
        own = docs.where(F.col("lang") == lang).withColumnRenamed("doc_id", "numéro" if bad else "doc_id")
        own = own.withColumn("lang", F.lit("düster")) if lang == "de" else own
        IO.write_csv(own.coalesce(1), f"{d}/{lang}", encoding="ISO-8859-1" if bad or lang == "de" else "UTF-8")
    bad = IO.rejected_files(spark, d, "*/*.csv").select(
        F.element_at(F.split("path", "/"), -2).alias("lang"), "reason", "bad_lines").withColumn("rejected", F.lit(True))
    read = IO.read_csv_folder(spark, d, skip_bad=True, pattern="*/*.csv").groupBy("lang").count()
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    out = counts.join(bad, "lang", "left").join(read, "lang", "left")
    # a file is either listed or read whole
    ok = F.col("rejected").isNotNull() & F.col("count").isNull() | F.col("rejected").isNull() & (F.col("count") == F.col("n_rows"))
    return out.select("lang", F.when(ok, F.coalesce("rejected", F.lit(False))).alias("rejected"), "reason", "bad_lines", "n_rows")


@register("reject_counts", """select lang, count(*) as n_rows, count(*) filter (where doc_id % 10 in (3, 7)) as n_unfit from documents group by lang""")
def q_reject_counts(spark, sf):
    """A3 below the header: in each language's CSV, every tenth id is no number and every tenth row has a field too many."""
    d = _dir(spark, sf, f"unfit_{uuid.uuid4().hex[:8]}")
    docs = table(spark, sf, "documents")
    line = F.concat_ws(",", F.when(F.col("doc_id") % 10 == 3, F.lit("no number")).otherwise(F.col("doc_id").cast("string")), "lang",
                       F.when(F.col("doc_id") % 10 == 7, F.concat(F.col("n_chars").cast("string"), F.lit(",more"))).otherwise(F.col("n_chars").cast("string")))
    for lang in [r["lang"] for r in docs.select("lang").distinct().collect()]:  # a handful
        rows = docs.where(F.col("lang") == lang).select(line.alias("value"))
        head = spark.range(1).select(F.lit("doc_id,lang,n_chars").alias("value"))
        head.unionByName(rows).coalesce(1).write.mode("overwrite").text(f"{d}/{lang}")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])
    got = IO.reject_counts(spark, d, schema, pattern="*/*.txt")
    return got.select(F.element_at(F.split("path", "/"), -2).alias("lang"), "n_rows", "n_unfit")


@register("read_any_formats", """select f.format, event_type, count(*) as n from events,
    (values ('csv'), ('json'), ('orc'), ('parquet')) f(format) group by 1, 2""")
def q_read_any_formats(spark, sf):
    """A5: the same rows written in four formats and read by the file suffix."""
    d = _dir(spark, sf, "any")
    e = table(spark, sf, "events").select("event_id", "event_type")
    parts = []
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{d}/events.{kind}"
        if kind == "csv":
            IO.write_csv(e, path)
        else:
            getattr(e.write.mode("overwrite"), kind)(path)
        parts.append(IO.read_any(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("format", F.lit(kind)))
    return IO.union_by_name(parts).select("format", "event_type", "n")


@register("gold_partial_overwrite", with_views(
    f"select * replace (case when day(date) % 2 = 0 then negative else 0 end as negative) from ({_CUBE}) c", "feedback"))
def q_gold_partial(spark, sf):
    """A second run that carries only the even days leaves the odd days as they were."""
    d = _dir(spark, sf, f"gold_partial_{uuid.uuid4().hex[:8]}")
    cube = normalize_columns(trend_daily(feedback(spark, sf)))
    IO.write_gold(cube.withColumn("negative", F.lit(0).cast("bigint")), d)
    IO.write_gold(cube.where(F.dayofmonth("date") % 2 == 0), d)
    return IO.read_zone(spark, d).select("date", "topic", "negative", "positive", "neutral", "total_volume", "negative_rate")
