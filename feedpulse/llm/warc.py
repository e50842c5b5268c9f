"""Operator 3, WARC: write archives with an index, read selected records back by byte ranges.

Each task writes its pages as gzip members (one per record) into archives of its own in the shared
folder, and returns one index row per record: file, offset, length, URL and digest. The index is a
table, written before anything is read. A reader takes selected index rows, deals them out by
(file, block), sorts them by offset and turns neighbours into one read of the coalesced range.
A file's name holds the task attempt; only rows of attempts that Spark committed are in the index,
so what a lost or repeated attempt has written is never read.

Of records with equal payloads (same SHA-1) of at least ``revisit_from`` bytes, the one with the
largest page id is the response; the others are revisit records that refer to it.

Defined results: a null html is an empty payload; a null URL is written as ``urn:none``; a null
page id counts as smaller than any other and, if a payload has no other, is a response; rows that
share the largest page id of a payload are all responses; an empty table writes no archive; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import shared_path, ship_code, stored

FILE_BYTES = 1 << 30        # an archive is closed beyond this
RANGE_BYTES = 8 << 20       # most bytes of one coalesced read (a longer record is read alone)
GAP_BYTES = 64 << 10        # unwanted bytes between records that a read may bridge
BLOCK_BYTES = 16 << 20      # index rows of one block of a file go to one task, and a task reads about so much
WARC_DATE = "2024-01-01T00:00:00Z"
INDEX = ("file string, offset bigint, length bigint, url string, digest string, page_id bigint, "
         "record_type string, refers_to bigint")
RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, payload binary")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def roles(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload, digest, and the response's page id where the row is a revisit."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"),
                        text.cast("binary").alias("payload"), F.unhex(F.sha1(text.cast("binary"))).alias("digest"))
    same = (rows.filter(F.octet_length("payload") >= revisit_from).groupBy("digest")
            .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top is not null"))
    same = stored(same.select("digest", "top"), "warc-copies")
    top = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top"))
    return rows.join(same, "digest", "left").select("page_id", "url", "payload", "digest", top.alias("refers_to"))


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, so the payload's length is known."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{page_id}:{digest}>", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"])
    return text.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean_url(url) -> str:
    """A header line holds no line breaks."""
    return "urn:none" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``roles`` below ``folder``; the index rows (evaluate once: use ``stored``)."""
    ship_code(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, count = None, "", 0, 0
        try:
            for b in batches:
                index = []
                for page, url, payload, digest, ref in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, count = f"{task.partitionId():06d}-{task.taskAttemptId()}-{count}.warc.gz", 0, count + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        info = b"software: feedpulse\r\nformat: WARC File Format 1.1\r\n"
                        at += out.write(_member(
                            b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:" + name.encode() + b">\r\nWARC-Date: "
                            + WARC_DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: "
                            + str(len(info)).encode() + b"\r\n\r\n" + info + b"\r\n\r\n"))
                    page = None if pd.isna(page) else int(page)
                    ref = None if pd.isna(ref) else int(ref)
                    data = _member(record_bytes(page, _clean_url(url), payload, base32(digest), ref))
                    out.write(data)
                    index.append((name, at, len(data), url, base32(digest), page, "response" if ref is None else "revisit", ref))
                    at += len(data)
                yield _frame(index, INDEX)
        finally:
            if out is not None:
                out.close()

    return rows.mapInPandas(run, INDEX)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]
    f = pd.DataFrame(rows, columns=names, dtype=object)
    for c in names:
        if f"{c} bigint" in ddl:
            f[c] = f[c].astype("Int64")
    return f


def parse(data: bytes) -> tuple:
    """One record's fields; raises if a stated length or digest is wrong."""
    raw = zlib.decompress(data, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode("utf-8", "surrogatepass").split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[cut + 4:cut + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if lines[0] != "WARC/1.1" or not revisit and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"broken record {head.get('WARC-Record-ID')}")
    page = head["WARC-Record-ID"].split(":")[2]
    ref = int(head["WARC-Refers-To"].split(":")[2]) if revisit else None
    return (None if page == "None" else int(page), head["WARC-Target-URI"], size, digest, head["WARC-Type"], ref,
            None if revisit else payload)


def ranges(files, offsets, lengths) -> Iterator[tuple[int, int]]:
    """[first, last) rows of each coalesced read; rows are sorted by file and offset."""
    first = 0
    for i in range(1, len(files) + 1):
        if (i == len(files) or files[i] != files[first] or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP_BYTES
                or offsets[i] + lengths[i] - offsets[first] > RANGE_BYTES):
            if i > first:
                yield first, i
            first = i


def read(index: DataFrame, folder: str, selected: Column | None = None) -> DataFrame:
    """The records of the selected index rows (all, without a condition), read by coalesced ranges."""
    ship_code(index.sparkSession)
    rows = index if selected is None else index.filter(selected)
    rows = rows.select("file", "offset", "length")
    # tasks by the bytes they will read; index rows are small, so their own size says nothing
    tasks = -(-(rows.agg(F.sum("length")).first()[0] or 1) // BLOCK_BYTES)
    rows = rows.repartition(tasks, "file", F.floor(F.col("offset") / BLOCK_BYTES)).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, f = None, None
        for b in batches:
            files, offsets, lengths = b["file"].tolist(), b["offset"].tolist(), b["length"].tolist()
            for first, last in ranges(files, offsets, lengths):
                if files[first] != name:
                    if f is not None:
                        f.close()
                    name, f = files[first], fs.open_input_file(f"{root}/{files[first]}")
                start = offsets[first]
                data = f.read_at(offsets[last - 1] + lengths[last - 1] - start, start)
                yield _frame([parse(data[offsets[i] - start:offsets[i] - start + lengths[i]]) for i in range(first, last)], RECORD)
        if f is not None:
            f.close()

    return rows.mapInPandas(run, RECORD)


def archive(pages: DataFrame, revisit_from: int = 0) -> tuple[DataFrame, str]:
    """Write all pages; their stored index and the archives' folder."""
    folder = shared_path(pages.sparkSession, "warc")
    return stored(write(roles(pages, revisit_from), folder), "warc-index"), folder
