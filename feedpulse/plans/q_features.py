"""Registered feature queries (D1-D8) and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedpulse.functions import text as X
from feedpulse.operators import features as D
from feedpulse.operators.split import split_random, split_stratified
from feedpulse.plans.registry import register
from feedpulse.plans.views import add_view_sql, emails, interactions, reviews, texts, with_views

_TOK = r"([\p{L}\p{N}_]{2,})"


def _stop_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in D.english_stop_words()) + "]"


def text_tokens(spark, sf, stop: bool = False, grams: int = 1):
    return _grams(texts(spark, sf).select("doc_id", D.tokens("text").alias("toks")), stop, grams)


def email_tokens(spark, sf, stop: bool = False, grams: int = 1):
    e = emails(spark, sf).select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), D.tokens("text").alias("toks"))
    return _grams(e, stop, grams)


def _grams(r, stop: bool, grams: int):
    if stop:
        r = D.remove_stop(r, "toks")
    if grams > 1:
        r = r.withColumn("toks", D.ngrams("toks", grams))
    return r


add_view_sql("rtok", f"select doc_id, regexp_extract_all(lower(text), '{_TOK}', 1) as toks from texts",
             ("texts",))
add_view_sql("etok", f"select concat_ws('/', conv_id, turn) as doc_id, regexp_extract_all(lower(text), '{_TOK}', 1) as toks from emails",
             ("emails",))
for _p in "re":  # of texts and of emails
    add_view_sql(f"{_p}stop", f"select doc_id, list_filter(toks, lambda t: not list_contains({_stop_sql()}, t)) as toks from {_p}tok",
                 (f"{_p}tok",))
    add_view_sql(f"{_p}gram", f"""select doc_id, case when len(toks) >= 2
        then list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))
        else toks end as toks from {_p}stop""", (f"{_p}stop",))


def _vocab_sql(src: str, min_df: int, k: int) -> str:
    return f"""select term, tf, df, cast(row_number() over (order by term) - 1 as int) as idx from (
        select term, cast(sum(tf) as bigint) as tf, count(*) as df from (
            select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from {src}) e
            group by doc_id, term) c
        group by term having count(*) >= {min_df} order by tf desc, term limit {k}) v"""


add_view_sql("vocab3000", _vocab_sql("rtok", 1, 3000), ("rtok",))


def _flat_sql(src: str) -> str:
    """Token arrays shown losslessly as '|'-joined text (tokens never contain '|') plus their count."""
    return f"select doc_id, array_to_string(toks, '|') as toks, cast(len(toks) as int) as n_tokens from {src}"


def _flat(df):
    return df.select("doc_id", F.array_join("toks", "|").alias("toks"), F.size("toks").alias("n_tokens"))


@register("tokens", with_views(_flat_sql("rtok"), "rtok"))
def q_tokens(spark, sf):
    return _flat(text_tokens(spark, sf))


@register("remove_stop", with_views(_flat_sql("rstop"), "rstop"))
def q_remove_stop(spark, sf):
    return _flat(text_tokens(spark, sf, stop=True))


@register("ngrams", with_views(_flat_sql("rgram"), "rgram"))
def q_ngrams(spark, sf):
    return _flat(text_tokens(spark, sf, stop=True, grams=2))


@register("fit_vocab", with_views("select * from vocab3000", "vocab3000"))
def q_fit_vocab(spark, sf):
    return D.fit_vocab(text_tokens(spark, sf), "doc_id", "toks", min_df=1, k=3000)


@register("fit_vocab_email", with_views(_vocab_sql("egram", 5, 5000), "egram"))
def q_fit_vocab_email(spark, sf):
    return D.fit_vocab(email_tokens(spark, sf, stop=True, grams=2), "doc_id", "toks", min_df=5, k=5000)


@register("tfidf", with_views(
    """select c.doc_id, c.term, v.idx, c.tf,
       round(c.tf * (ln((1 + n) / (1 + v.df)) + 1)
             / sqrt(sum(power(c.tf * (ln((1 + n) / (1 + v.df)) + 1), 2)) over (partition by c.doc_id)), 6) as weight
    from (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from rtok) e
          group by doc_id, term) c
    join vocab3000 v on c.term = v.term, (select count(*) as n from rtok) nd""", "vocab3000", "rtok"))
def q_tfidf(spark, sf):
    toks = text_tokens(spark, sf)
    vocab = D.fit_vocab(toks, "doc_id", "toks", min_df=1, k=3000)
    out = D.tfidf(toks, vocab, "doc_id", "toks")
    return out.withColumn("weight", F.round("weight", 6))


@register("fit_index_user", with_views(
    "select user_id, dense_rank() over (order by user_id) - 1 as idx "
    "from (select distinct user_id from interactions where user_id is not null) u", "interactions"))
def q_fit_index_user(spark, sf):
    return D.fit_index(interactions(spark, sf), "user_id")


_SPLIT_KEY = "concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
add_view_sql("isplit", f"""select *, cast(('0x' || substr(md5({_SPLIT_KEY}), 1, 8)) as bigint) < {int(0.2 * (1 << 32))}
    as is_test from interactions""", ("interactions",))


@register("split_random", with_views(
    "select is_test, count(*) as n, count(distinct item_id) as items from isplit group by is_test", "isplit"))
def q_split_random(spark, sf):
    s = split_random(interactions(spark, sf), _KEYS, 0.2, 42)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))


@register("apply_index", with_views(
    """with d as (select item_id, dense_rank() over (order by item_id) - 1 as idx
                 from (select distinct item_id from isplit where not is_test) t)
    select t.l_orderkey, t.l_linenumber, t.l_partkey, t.item_id, coalesce(d.idx, 0) as idx,
           d.item_id is null as is_cold_start
    from isplit t left join d on t.item_id = d.item_id where t.is_test""", "isplit"))
def q_apply_index(spark, sf):
    s = split_random(interactions(spark, sf), _KEYS, 0.2, 42)
    dic = D.fit_index(s.where(~F.col("is_test")), "item_id")
    test = s.where("is_test").select("l_orderkey", "l_linenumber", "l_partkey", "item_id")
    return D.apply_index(test, dic, "item_id")


@register("split_stratified", with_views(
    """select doc_id, label, row_number() over (partition by label order by
         cast(('0x' || substr(md5(concat_ws('|', '42', doc_id)), 1, 8)) as bigint), doc_id)
         <= ceil(0.2 * count(*) over (partition by label)) as is_test
    from reviews""", "reviews"))
def q_split_stratified(spark, sf):
    return split_stratified(reviews(spark, sf).select("doc_id", "label"), ["doc_id"], "label", 0.2, 42)


@register("split_stratified_topic", with_views(
    """select doc_id, topic, row_number() over (partition by topic order by
         cast(('0x' || substr(md5(concat_ws('|', '7', doc_id)), 1, 8)) as bigint), doc_id)
         <= ceil(0.2 * count(*) over (partition by topic)) as is_test
    from texts""", "texts"))
def q_split_stratified_topic(spark, sf):
    return split_stratified(texts(spark, sf).select("doc_id", "topic"), ["doc_id"], "topic", 0.2, 7)


@register("clean_then_tokens", with_views(
    f"""select doc_id, array_to_string(t, '|') as toks, cast(len(t) as int) as n_tokens from (
      select doc_id, regexp_extract_all(lower(c), '{_TOK}', 1) as t
      from (select doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_{X.WS}]', '', 'g') as c from texts) r) x""",
    "texts"))
def q_clean_then_tokens(spark, sf):
    return _flat(texts(spark, sf).select("doc_id", D.tokens(X.clean_words("text")).alias("toks")))


@register("tfidf_vectors", with_views(
    """select c.doc_id, v.idx,
       round(c.tf * (ln((1 + n) / (1 + v.df)) + 1)
             / sqrt(sum(power(c.tf * (ln((1 + n) / (1 + v.df)) + 1), 2)) over (partition by c.doc_id)), 6) as weight
    from (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from rtok) e
          group by doc_id, term) c
    join vocab3000 v on c.term = v.term, (select count(*) as n from rtok) nd""", "vocab3000", "rtok"))
def q_tfidf_vectors(spark, sf):
    """D8/D9 vector form: the Spark ML stages a model is fitted on give the SQL tf-idf weights."""
    from pyspark.ml.functions import vector_to_array
    toks = text_tokens(spark, sf)
    vocab = D.fit_vocab(toks, "doc_id", "toks", min_df=1, k=3000)
    n_docs = toks.count()
    stages = D.vectorizer_stages(vocab, "toks", "features", n_docs)
    v = toks
    for st in stages:
        v = st.transform(v)
    arr = v.select("doc_id", F.posexplode(vector_to_array("features")).alias("idx", "weight"))
    return arr.where(F.col("weight") != 0).select("doc_id", F.col("idx").cast("int").alias("idx"),
                                                   F.round("weight", 6).alias("weight"))


@register("fitted_stage_tokens", with_views(_flat_sql("rgram"), "rgram"))
def q_fitted_stage_tokens(spark, sf):
    """The token stages stored inside fitted pipelines (stop words, bigrams) equal the column functions."""
    from pyspark.ml import Pipeline
    from feedpulse.operators.train import _token_stages
    r = texts(spark, sf).select("doc_id", "text")
    model = Pipeline(stages=_token_stages("text", "toks", stop=True, grams=2)).fit(r)
    return _flat(model.transform(r).select("doc_id", "toks"))


@register("split_stratified_nulls", """with x as (select doc_id, case when doc_id % 3 <> 0 then source end as topic from documents)
    select doc_id, topic, row_number() over (partition by topic order by
         cast(('0x' || substr(md5(concat_ws('|', '5', doc_id)), 1, 8)) as bigint), doc_id)
         <= ceil(0.2 * count(*) over (partition by topic)) as is_test from x""")
def q_split_stratified_nulls(spark, sf):
    """E1 with a third of the labels null: they are a class of their own."""
    d = texts(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("topic")).alias("topic"))
    return split_stratified(d, ["doc_id"], "topic", 0.2, 5)
