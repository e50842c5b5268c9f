"""Operator 3: round trip, revisits, selected ranges."""

import base64
import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from feedpulse.llm import warc

HTML = [None, "", "a", "same", "same", "same", "é🎉 <p>\r\n\r\nx</p>", "z" * 200_000, "WARC/1.1\r\n\r\n", "\x00"]


def pages(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(HTML)] + [(None, None, "same"), (None, "bad\r\nurl", "only null"), (3, "http://h/3", "same")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return rows, df.select("*", *[F.lit(1).alias(c) for c in ("digest", "payload", "file", "offset", "length", "top")])


def test_round_trip(spark):
    rows, df = pages(spark)
    index, folder = warc.archive(df)
    got = warc.read(index, folder).collect()
    top = {}
    for i, _, h in rows:
        h = h or ""
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    expected = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        t = top[h or ""]
        ref = t if t >= 0 and (i is None or i < t) else None
        expected[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref,
                 None if ref is not None else b] += 1
    assert expected == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                                None if r["payload"] is None else bytes(r["payload"])) for r in got)


def test_archives_are_whole_gzip_warc_files_and_selection_reads_parts(spark):
    _, df = pages(spark)
    index, folder = warc.archive(df.coalesce(1))
    some = warc.read(index, folder, F.col("page_id").isin(2, 7)).collect()
    assert sorted(r["page_id"] for r in some) == [2, 7]
    import pyarrow.fs as pafs
    fs, root = pafs.FileSystem.from_uri(folder)
    n = 0
    for f in {r["file"] for r in index.collect()}:
        data = fs.open_input_file(f"{root}/{f}").readall()
        while data:  # one member after the other
            z = zlib.decompressobj(31)
            assert z.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = z.unused_data, n + 1
    assert n == index.count() + len({r["file"] for r in index.collect()})


def test_ranges_coalesce():
    k = warc.GAP_BYTES
    assert list(warc.ranges(["a", "a", "a", "b"], [0, 10, 20 + 2 * k, 0], [10, 10, 5, 5])) == [(0, 2), (2, 3), (3, 4)]
    assert list(warc.ranges(["a", "a"], [0, warc.RANGE_BYTES], [warc.RANGE_BYTES, 9])) == [(0, 1), (1, 2)]
    assert list(warc.ranges([], [], [])) == []


def test_revisit_threshold_and_empty_table(spark):
    _, df = pages(spark)
    index, folder = warc.archive(df, revisit_from=5)
    assert {r["record_type"] for r in warc.read(index, folder).collect()} == {"response"}
    index, folder = warc.archive(df.limit(0))
    assert warc.read(index, folder).count() == 0
