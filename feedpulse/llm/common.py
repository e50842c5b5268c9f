"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from feedpulse.session import scratch_path

# The characters between words, as a pattern and as text (\x20 and \x09-\x0D).
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``; no two calls share one."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:16]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there, the
    rows no longer change with a retry, and every later use reads them instead of computing them."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Make the session ready for this package's functions: its code goes to the Python workers (once per
    context), as ``spark-submit --py-files`` does, so an executor needs no copy of the repository."""
    # a worker holds its batch several times over (text, words, hashes), so batches are kept small
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("64m", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    sc = spark.sparkContext
    name = "feedpulse-code.zip"
    if name in sc._python_includes:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="feedpulse-code-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now instead of at its next
    periodic collection (half an hour): their frames are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


try:
    _LIBC_TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _LIBC_TRIM = None


def trim() -> None:
    """Give a Python worker's freed memory back to the system: workers live on between the stages of a job,
    and what they hold counts as their executor's."""
    pa.default_memory_pool().release_unused()
    if _LIBC_TRIM is not None:
        _LIBC_TRIM(0)


def free_name(df_columns, base: str) -> str:
    """``base``, or ``base`` with underscores, so that it clashes with no column (any case)."""
    taken = {c.lower() for c in df_columns}
    while base.lower() in taken:
        base = "_" + base
    return base


# ------------------------------------------------------------------ vectorised word hashes

_TABLE = np.random.default_rng(20240101).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE_TABLE = np.zeros(256, dtype=bool)
_SPACE_TABLE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: each step multiplies what is known
        k = min(done, n - done)
        out[done:done + k] = out[:k] * (out[done - 1:done] * base)
        done += k
    return out


_POWERS = {"n": 0, "up": None, "down": None}


def _tables(n: int):
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        _POWERS.update(n=size, up=_powers(_BASE, size), down=_powers(_INV, size))
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word of ``data``; words are the runs of bytes between the
    six space characters. A polynomial over randomised bytes, taken by prefix sums, then mixed."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint64)
    word = ~_SPACE_TABLE[b]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * up[:len(b)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
    return start, end, mix(h)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def word_chunks(texts: list, lower: bool = False, limit: int = 1 << 20):
    """Word hashes of many texts at once: yields (first row, last row, data, word starts, word ends,
    hashes, bounds) for runs of rows of about ``limit`` bytes; the words of row ``first + i`` are
    bounds[i] to bounds[i + 1]. A longer text is a run of its own; a null text has no words."""
    first, held, size = 0, [], 0

    def done(last: int):
        data = b"\n".join(held)
        start, end, h = word_hashes(data)
        at = np.zeros(len(held) + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in held], out=at[1:])
        return first, last, data, start, end, h, np.searchsorted(start, at)

    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        b = b.lower() if lower else b  # bytes: A-Z only
        if held and size + len(b) > limit:
            yield done(i)
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield done(len(texts))
    trim()
