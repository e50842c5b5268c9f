"""Text features and id encoders.

Long form first: ``(doc, term, weight)`` rows are plain SQL and exactly
checkable; the vector form for model fitting reuses Spark ML transformers
(CountVectorizerModel over the fitted vocabulary, ElementwiseProduct with
the smoothed idf, Normalizer) so scoring stays in the JVM.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpulse.functions.stopwords import ENGLISH
from feedpulse.operators.ordering import dense_index

TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"
COUNTED_TERMS = 1 << 20  # terms that a worker counts at once


def english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop-word list (plain values: no JVM or file access)."""
    return ENGLISH


# ------------------------------------------------------------------ encoders

def fit_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Sorted distinct values -> 0..n-1 (as a label encoder), without a one-task sort."""
    return dense_index(df.select(F.col(col).cast("string").alias(col)), col, out)


def apply_index(df: DataFrame, dictionary: DataFrame, col: str, out: str = "idx",
                cold_flag: str | None = "is_cold_start", value_col: str = "idx",
                dict_key: str | None = None) -> DataFrame:
    """Look values up in a fitted dictionary; unseen -> 0 and flagged cold.

    A left equi-join: Spark broadcasts the dictionary only when its measured
    size is under the broadcast threshold, otherwise shuffles both sides.
    """
    d = dictionary.select(F.col(dict_key or col).alias("__k"), F.col(value_col).alias("__v"))
    j = df.join(d, df[col].cast("string") == d["__k"], "left")
    j = j.withColumn(out, F.coalesce(F.col("__v"), F.lit(0)))
    if cold_flag:
        j = j.withColumn(cold_flag, F.col("__k").isNull())
    return j.drop("__k", "__v")


# ------------------------------------------------------------------ tokens

def tokens(c: Column | str) -> Column:
    """Lower-case word runs of two or more characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 1)


def stop_remover(input_col: str, output_col: str, stop: tuple[str, ...] | None = None):
    """D5 as an ML stage: hash-set lookup in the JVM, order and repeats kept."""
    from pyspark.ml.feature import StopWordsRemover
    words = list(stop if stop is not None else english_stop_words())
    return StopWordsRemover(inputCol=input_col, outputCol=output_col, stopWords=words, caseSensitive=True)


def remove_stop(df: DataFrame, col: str, out: str | None = None, stop: tuple[str, ...] | None = None) -> DataFrame:
    """Drop stop words from an array column of lower-case tokens."""
    out = out or col
    tmp = "__nostop"
    d = stop_remover(col, tmp, stop).transform(df)
    return d.drop(col).withColumnRenamed(tmp, out) if out == col else d.withColumnRenamed(tmp, out)


def ngrams(toks: Column | str, n_max: int = 2) -> Column:
    """Unigrams followed by the space-joined 2..n_max-grams.

    The shifted copies of the token array are zipped once per row; no lambda
    refers back to the token expression, so it is never re-evaluated per element.
    """
    toks = F.col(toks) if isinstance(toks, str) else toks
    out = toks
    big = 1 << 30
    for n in range(2, n_max + 1):
        z = F.arrays_zip(*[F.slice(toks, j + 1, big).alias(f"t{j}") for j in range(n)])
        joined = F.transform(z, lambda s: F.concat_ws(" ", *[s[f"t{j}"] for j in range(n)]))
        grams = F.slice(joined, 1, F.greatest(F.size(toks) - n + 1, F.lit(0)))
        out = F.concat(out, grams)
    return out


# ------------------------------------------------------------------ vocabulary / tf-idf

def term_counts(df: DataFrame, doc: str, terms: str) -> DataFrame:
    """(doc, term, tf) for every term occurrence; keyed by doc so no hot key.

    ``explode_outer`` + a null filter: a plain ``explode`` makes Catalyst infer
    ``size(tokens) > 0`` and push it below joins, re-running the tokenizer
    expression on every input row.
    """
    return (df.select(doc, F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())
              .groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf")))


def fit_vocab(df: DataFrame, doc: str, terms: str, min_df: int = 1, k: int | None = None) -> DataFrame:
    """Terms with document frequency >= min_df, top-k by corpus frequency; a row is a document.

    Returns (term, tf, df, idx) where idx is the alphabetical position among
    the kept terms. Top-k is a bounded TakeOrderedAndProject (k rows).
    """
    return pick_terms(count_terms(df, terms), min_df, k)


def count_terms(df: DataFrame, terms: str) -> DataFrame:
    """(term, tf, df) of all rows. Documents do not move: the terms of a batch of rows are numbered and counted in
    their worker, and only its distinct terms with their counts are shuffled."""
    most = COUNTED_TERMS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(0)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            at = 0
            while at < len(ends):  # whole rows, of a bounded number of terms unless one row has more
                z = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
                coded = b.column(0).slice(at, z - at).flatten().dictionary_encode()
                own, codes = np.repeat(np.arange(z - at), sizes[at:z]), coded.indices
                if codes.null_count:
                    own, codes = own[codes.is_valid().to_numpy(zero_copy_only=False)], codes.drop_null()
                codes, n = codes.to_numpy().astype(np.int64), len(coded.dictionary)
                if n:
                    pairs = np.sort(own * n + codes)
                    first = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))] % n  # a term once for each of its rows
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(codes, minlength=n)), pa.array(np.bincount(first, minlength=n))],
                                                     ["term", "tf", "df"])
                at = z

    e = df.select(F.col(terms).cast("array<string>")).mapInArrow(counted, "term string, tf bigint, df bigint")
    return e.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def pick_terms(counts: DataFrame, min_df: int = 1, k: int | None = None) -> DataFrame:
    """The vocabulary (term, tf, df, idx) from the counts of all terms."""
    v = counts.where(F.col("df") >= min_df)
    if k is not None:
        v = v.orderBy(F.desc("tf"), F.asc("term")).limit(k)
        # k rows at most: a global window over them is bounded
        return v.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    return v.join(dense_index(v.select("term"), "term", "idx"), "term")


def tfidf(df: DataFrame, vocab: DataFrame, doc: str, terms: str, n_docs: DataFrame | None = None) -> DataFrame:
    """Tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised per document (long form).

    ``n_docs`` is a one-row frame with column ``n`` (documents the vocabulary
    was fitted on); by default the documents of ``df``. A vocabulary of up to ``MAX_VECTOR_TERMS`` terms
    (checked) is applied inside the rows: counts, weights and norm of a document are one sparse vector,
    and nothing is shuffled. A larger one is joined by term.
    """
    if n_docs is None:
        n_docs = df.agg(F.count(F.lit(1)).alias("n"))
    if (rows := bounded_vocab(vocab, MAX_VECTOR_TERMS)) is None:
        return _tfidf_by_join(df, vocab, doc, terms, n_docs)
    n = n_docs.select("n").first()[0]
    d = df.select(doc, F.coalesce(F.col(terms), F.array().cast("array<string>")).alias("__terms"))
    for stage in _stages(rows, "__terms", "__weights", n):
        d = stage.transform(d)
    idx, tf = sparse_parts("__tf")
    parts = F.arrays_zip(idx.alias("idx"), tf.alias("tf"), sparse_parts("__weights")[1].alias("weight"))
    names = F.from_json(F.lit(json.dumps([r["term"] for r in rows])), "array<string>")  # folded to one constant
    return d.select(doc, F.explode_outer(parts).alias("p")).where("p is not null").select(
        doc, F.get(names, F.col("p.idx")).alias("term"), "p.idx", F.col("p.tf").cast("long").alias("tf"), "p.weight")


def _tfidf_by_join(df: DataFrame, vocab: DataFrame, doc: str, terms: str, n_docs: DataFrame) -> DataFrame:
    """The weights of a vocabulary without a bound: counts by (document, term) join it by term."""
    from feedpulse.operators.kpi import scalar_join
    idf = scalar_join(vocab.select("term", "idx", F.col("df").alias("__df")), n_docs.select(F.col("n").alias("__n"))) \
        .select("term", "idx", (F.log((1 + F.col("__n")) / (1 + F.col("__df"))) + 1).alias("idf"))
    w = term_counts(df, doc, terms).join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, "term", "idx", "tf", (F.col("w") / norm).alias("weight"))


def sparse_parts(vector: Column | str) -> tuple[Column, Column]:
    """(indices, values) of a vector column as arrays, read from its row without making it dense."""
    u = F.unwrap_udt(F.col(vector) if isinstance(vector, str) else vector)
    dense = F.transform(u["values"], lambda v, i: i)
    return F.when(u["type"] == 0, u["indices"]).otherwise(dense), u["values"]


def bounded_vocab(vocab: DataFrame, most: int) -> list | None:
    """The vocabulary's rows by idx, or None if there are more than ``most``: that many and one are fetched at most."""
    rows = vocab.select("term", "df", "idx").limit(most + 1).collect()
    return sorted(rows, key=lambda r: r["idx"]) if len(rows) <= most else None


MAX_VECTOR_TERMS = 1 << 18  # a sparse vector's vocabulary is one object on the driver and in every task


def vectorizer_stages(vocab: DataFrame, input_col: str, output_col: str = "features",
                      n_docs: int | None = None, max_terms: int = MAX_VECTOR_TERMS):
    """D8/D9 vector form: Spark ML stages reproducing the smoothed tf-idf.

    The vocabulary (at most max_features terms) is brought to the driver once
    to parameterise the stages; documents never are.
    """
    rows = bounded_vocab(vocab, max_terms)
    if rows is None:
        raise ValueError(f"vocabulary of more than {max_terms} terms; fit it with max_features")
    if n_docs is None:
        raise ValueError("n_docs is required")
    return _stages(rows, input_col, output_col, n_docs)


def _stages(rows: list, input_col: str, output_col: str, n_docs: int) -> list:
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors
    terms = [r["term"] for r in rows] or ["\u0000"]  # a vocabulary without terms: one that no token is
    idf = [math.log((1 + n_docs) / (1 + r["df"])) + 1 for r in rows] or [1.0]
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol=input_col, outputCol="__tf")
    ew = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf")
    nm = Normalizer(p=2.0, inputCol="__tfidf", outputCol=output_col)
    return [cv, ew, nm]


def assemble(text_col: str = "features", extra: tuple[str, ...] = ("user_idx", "item_idx"),
             output_col: str = "x"):
    """Text vector plus passthrough numeric ids as one feature vector."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=[text_col, *extra], outputCol=output_col, handleInvalid="keep")
