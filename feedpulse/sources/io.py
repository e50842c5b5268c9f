"""File sources and sinks.

CSV folders whose files carry different headers are read one reader per
distinct header and unioned by name. Headers are read from the first line of
each file through the Hadoop FileSystem (metadata-sized driver work); the
rows themselves are only ever read by Spark tasks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedpulse.session import written

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"',
               "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "quoteAll": "true",
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    fs, jvm = _fs(spark, folder)
    st = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}"))
    return sorted(str(s.getPath().toString()) for s in (st or []) if s.isFile() and s.getLen() > 0)


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str | None:
    """The header line; None if its bytes are not text of the encoding. A storage error is raised."""
    fs, jvm = _fs(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
    charset = jvm.java.nio.charset.Charset.forName(encoding)
    # where line ends are single bytes, only the header's own bytes are decoded, not what is read ahead
    by_bytes = not str(charset.name()).startswith(("UTF-16", "UTF-32"))
    try:
        decoder = (jvm.java.nio.charset.StandardCharsets.ISO_8859_1 if by_bytes else charset).newDecoder()  # reports malformed input
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, decoder)).readLine()
        if line is not None and by_bytes:
            line = line.encode("latin-1").decode(encoding)
        return None if line is None else line.lstrip("\ufeff")
    except UnicodeDecodeError:
        return None
    except Py4JJavaError as e:
        if "CharacterCodingException" in str(e.java_exception.getClass().getSuperclass()) or "CharacterCodingException" in str(e.java_exception):
            return None
        raise
    finally:
        stream.close()


def _header_columns(line: str) -> list[str]:
    import csv
    return next(csv.reader([line]))


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType | None = None,
                    columns: Sequence[str] | None = None, skip_bad: bool = False,
                    encoding: str = "UTF-8", pattern: str = "*.csv",
                    corrupt_col: str | None = None, multi_line: bool = False) -> DataFrame:
    """Every CSV of a folder, union by column name (missing -> null).

    Files sharing a header are read by one reader (all columns string unless
    ``schema`` names them); ``columns`` prunes to a subset; ``skip_bad`` skips
    files that are no text of the encoding, as ``rejected_files`` lists them; storage errors are raised.
    Large files are split over tasks; ``multi_line=True`` reads quoted line breaks, at one task a file.
    ``corrupt_col`` keeps rows that do not fit the schema, with their raw text
    in that column (``columnNameOfCorruptRecord``) instead of failing.
    """
    groups: OrderedDict[tuple[str, ...], list[str]] = OrderedDict()
    bad = {r["path"] for r in bad_lines(spark, folder, pattern, encoding).collect()} if skip_bad else set()  # at most one row per file
    for f in list_files(spark, folder, pattern):
        line = None if f in bad else first_line(spark, f, encoding)
        if line is None:
            if skip_bad:
                continue
            raise ValueError(f"unreadable CSV header: {f}")
        groups.setdefault(tuple(_header_columns(line)), []).append(f)
    typed = {fld.name: fld for fld in (schema.fields if schema else [])}
    parts = []
    for header, files in groups.items():
        sch = T.StructType([typed.get(c, T.StructField(c, T.StringType())) for c in header])
        if corrupt_col:
            sch = sch.add(T.StructField(corrupt_col, T.StringType()))
        r = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).option("encoding", encoding).schema(sch)
        if corrupt_col:
            r = r.option("columnNameOfCorruptRecord", corrupt_col)
        parts.append(r.csv(files))
    if not parts:
        fields = schema.fields if schema else [T.StructField(c, T.StringType()) for c in (columns or [])]
        return spark.createDataFrame([], T.StructType(fields))
    out = union_by_name(parts)
    if schema is not None:
        for fld in schema.fields:
            if fld.name not in out.columns:
                out = out.withColumn(fld.name, F.lit(None).cast(fld.dataType))
        out = out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields],
                         *[F.col(f"`{c}`") for c in out.columns if c not in typed])
    if columns is not None:
        out = out.select(*[F.col(f"`{c}`") for c in columns])
    return out


def rejected_files(spark: SparkSession, folder: str, pattern: str = "*.csv", encoding: str = "UTF-8") -> DataFrame:
    """A3: path, reason and number of bad lines of every file that ``read_csv_folder(skip_bad=True)`` skips; empty
    if there is none. Headers are read first; of the other files every line is checked, in split text scans."""
    heads = [f for f in list_files(spark, folder, pattern) if first_line(spark, f, encoding) is None]
    rows = spark.createDataFrame([(f, f"header is not {encoding} text") for f in heads], "path string, reason string")
    bad = bad_lines(spark, folder, pattern, encoding)
    below = bad.join(rows.select("path"), "path", "left_anti").select("path", F.lit(f"a line below the header is not {encoding} text").alias("reason"))
    return rows.unionByName(below).join(bad, "path", "left").select("path", "reason", F.coalesce("bad_lines", F.lit(1)).alias("bad_lines"))


def bad_lines(spark: SparkSession, folder: str, pattern: str = "*.csv", encoding: str = "UTF-8") -> DataFrame:
    """Files with lines that are no text of the encoding, and how many (path, bad_lines)."""
    files = list_files(spark, folder, pattern)
    if not files or encoding.upper().replace("_", "-") not in ("UTF-8", "UTF8"):
        return spark.createDataFrame([], "path string, bad_lines bigint")  # one-byte encodings know no bad bytes
    t = spark.read.text(files).select(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("path"), "value")
    found = t.where(F.expr("not is_valid_utf8(value)")).groupBy("path").agg(F.count(F.lit(1)).alias("bad_lines"))
    plain = {_plain(f): f for f in files}  # the scan may write a path's scheme in another way
    names = spark.createDataFrame(list(plain.items()), "plain string, file string")
    return found.join(names, F.regexp_replace("path", "^[a-z0-9]+:/+", "/") == F.col("plain")).select(F.col("file").alias("path"), "bad_lines")


def _plain(path: str) -> str:
    import re
    return re.sub("^[a-z0-9]+:/+", "/", path)


def reject_counts(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.csv", encoding: str = "UTF-8",
                  multi_line: bool = False) -> DataFrame:
    """A3 by file: rows that were read and rows that do not fit ``schema`` (too many or too few fields, or a value of
    another type), for the files that are not rejected as a whole."""
    mark = "__unfit"
    d = read_csv_folder(spark, folder, schema, skip_bad=True, encoding=encoding, pattern=pattern, corrupt_col=mark, multi_line=multi_line)
    cols = [f"`{f.name}`" for f in schema.fields]
    # the reader checks no column that is not asked for: all are parsed, and what was found is written
    d = written(d.select(F.input_file_name().alias("path"), F.xxhash64(*cols).alias("row"), F.col(mark).isNotNull().alias("unfit")), "unfit-rows")
    return d.groupBy("path").agg(F.count("row").alias("n_rows"), F.count_if("unfit").alias("n_unfit"))


def union_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """A2: union all by column name; a column missing on one side is null there."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def read_zone(spark: SparkSession, path: str) -> DataFrame:
    """A4: Parquet zone scan (filters and projections reach the reader)."""
    return spark.read.parquet(path)


def write_zone(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A4: Parquet zone sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_any(spark: SparkSession, path: str, **csv_kw) -> DataFrame:
    """A5: reader chosen by the file suffix."""
    p = path.rstrip("/").lower()
    if p.endswith(".csv"):
        return spark.read.options(**CSV_OPTIONS).options(**csv_kw).csv(path)
    if p.endswith(".json") or p.endswith(".jsonl"):
        return spark.read.json(path)
    if p.endswith(".orc"):
        return spark.read.orc(path)
    return spark.read.parquet(path)


def _by_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The lines of the files below a folder as text, with the (decoded) path of their file."""
    t = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    return t.select(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"), "value")


def detect_encodings(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Per file, its header line, and UTF-8 when every line is valid UTF-8, else ISO-8859-1.

    A line-split text scan (the text source keeps the raw bytes), aggregated per
    file: large files are split across tasks instead of being loaded whole.
    """
    lines = _by_file(spark, folder, pattern)
    per_file = lines.groupBy("path").agg(
        F.bool_and(F.expr("is_valid_utf8(value)")).alias("ok"),
        F.min_by(F.col("value").cast("binary"), F.struct("block", "line")).alias("header"))
    return per_file.select("path", F.when(F.col("ok"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), "header")


def read_csv_any_encoding(spark: SparkSession, folder: str, schema: T.StructType | None = None,
                          pattern: str = "*.csv", multi_line: bool = False) -> DataFrame:
    """Read each file with its detected encoding (UTF-8, falling back to Latin-1), by name.

    Files are grouped by encoding and header; the driver holds one row per file, as
    the reader needs their paths anyway.
    """
    groups: dict[tuple, list[str]] = {}
    for r in detect_encodings(spark, folder, pattern).collect():
        header = tuple(_header_columns(bytes(r["header"]).decode(r["encoding"]).lstrip("\ufeff").rstrip("\r")))
        groups.setdefault((r["encoding"], header), []).append(r["path"])
    typed = {f.name: f for f in (schema.fields if schema else [])}
    parts = []
    for (e, header), files in sorted(groups.items()):
        own = T.StructType([typed.get(c, T.StructField(c, T.StringType())) for c in header])
        parts.append(spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).option("encoding", e).schema(own).csv(sorted(files)))
    if not parts:
        return spark.createDataFrame([], schema or T.StructType([]))
    out = union_by_name(parts)
    if schema is not None:
        for f in schema.fields:
            if f.name not in out.columns:
                out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
        out = out.select(*[F.col(f"`{f.name}`") for f in schema.fields])
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """CSV with a header row, every field quoted so texts round-trip."""
    df.write.mode(mode).options(**CSV_WRITE_OPTIONS).option("encoding", encoding).csv(path)


def batch_summary(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """A10: ``total_rows`` (and ``total_days`` when a date column is given) in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    if date_col:
        aggs.append(F.countDistinct(F.to_date(date_col)).alias("total_days"))
    return df.agg(*aggs)


def write_gold(df: DataFrame, path: str, partition: str | Sequence[str] = "date") -> None:
    """Overwrite only the partitions present in ``df`` (dynamic partition overwrite)."""
    cols = [partition] if isinstance(partition, str) else list(partition)
    # rows of one partition value meet before the write: few files; AQE splits large values
    (df.repartition(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*cols).parquet(path))


def decode_text(b: str) -> "F.Column":
    """A7 per value: a binary column -> text, UTF-8 when valid, else ISO-8859-1."""
    valid = F.expr(f"is_valid_utf8(cast(`{b}` as string))")
    return F.when(valid, F.decode(F.col(b), "UTF-8")).otherwise(F.decode(F.col(b), "ISO-8859-1"))


def json_safe(df: DataFrame) -> DataFrame:
    """A9 for a whole result: NaN / +-Inf -> null in every float and double column."""
    from feedpulse.functions.text import null_nonfinite
    return df.select(*[null_nonfinite(F.col(f"`{f.name}`")).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
                       for f in df.schema.fields])
