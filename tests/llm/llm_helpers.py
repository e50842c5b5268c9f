"""Small tables and brute-force versions for the tests of the training-data operators."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows, extra=("n_words", "key", "part", "node", "starts", "th", "rank", "size", "text_crc32", "rep", "n_chars")):
    """doc_id, text and columns with names that the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit(None).cast("bigint").alias(c) for c in extra])


ODD_TEXTS = [None, "", " \t\n", "a", "a b c d", "Straße\u00a0x é\u0085y z 你好 🎉", "x" * 5000]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
