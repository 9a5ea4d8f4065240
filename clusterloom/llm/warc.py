"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: each task streams its pages into WARC/1.1 files of bounded size, a gzip member
for each record, under the shared folder, through Arrow's file systems (local, HDFS or an object store by URI).
A file has a fresh name for each attempt and only the index rows of the attempt that
succeeds are kept, so a lost executor leaves at most a file that no index names. The
index holds file, offset and length (of the member), URL, digest and the rest of what a
selection needs for each record, and is a Parquet table.

Of records with equal payloads the one with the largest id carries the payload
(response); the others are revisit records that refer to it and carry headers
alone. That is decided from (id, digest) rows before any payload moves.

Reading: the selected index rows of a file are sorted by offset, neighbours closer
than ``GAP`` bytes become one range of at most ``RANGE`` bytes (or one record), and
each range is one read. Records are parsed from their bytes and checked against
the index: id, type, and for responses the digest of the payload itself.

Defined results: a null payload is the empty text; a null URL is left out of the
record; payloads smaller than ``least`` bytes are all responses; rows that repeat an
id and a payload are all written, all with the same type; a row without id is a
response.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.session import cut_lineage, ensure_checkpoint_dir

FILE_BYTES = 16 << 20
GZIP_LEVEL = 1
GAP, RANGE = 64 << 10, 8 << 20
LEAST = 0

#: The date of every record; the tables have none.
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"

INDEX = ("file string, offset long, length long, _id long, url string, digest string, payload_bytes long, "
         "record_type string, refers_to long")


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def location(root: str) -> tuple[fs.FileSystem, str]:
    """The file system and folder of a path or URI."""
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else root.replace("file:", "file://", 1))


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha: str,
           refers_to: int | None) -> bytes:
    """One record's bytes. ``payload`` None: a revisit."""
    kind = "response" if payload is not None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{sha}")
    body = payload if payload is not None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + _END + body + _END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record's bytes."""
    head, _, rest = data.partition(_END)
    version, *lines = head.decode("utf-8").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != _END:
        raise ValueError("a record's length doesn't fit its content")
    return headers, rest[:size]


# ------------------------------------------------------------------ writing

def _writer(root: str, file_bytes: int):
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
             pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = location(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, first in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    if out is None:
                        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = system.open_output_stream(f"{folder}/{name}", compression=None), 0
                    body = (payload or "").encode("utf-8", "replace")
                    sha = digest(body)
                    revisit = first is not None and first != page_id
                    data = gzip.compress(record(page_id, url, None if revisit else body, len(body), sha,
                                                first if revisit else None), GZIP_LEVEL, mtime=0)
                    out.write(data)
                    rows.append((name, at, len(data), page_id, url, sha, len(body),
                                 "revisit" if revisit else "response", first if revisit else None))
                    at += len(data)
                    if at >= file_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names) \
                    if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)
        finally:
            if out is not None:
                out.close()
    return run


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives under ``root`` (a shared folder) and return the index, written as a table."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("_payload"))
    system, folder = location(root)
    system.create_dir(folder, recursive=True)
    keyed = rows.withColumn("_sha", F.sha1(F.col("_payload").cast("binary")))
    found = cut_lineage(keyed.select("_id", "_sha", F.octet_length("_payload").alias("_size")))
    named = found.where(F.col("_id").isNotNull() & (F.col("_size") >= least))
    last = named.groupBy("_sha").agg(F.max("_id").alias("_last"))
    revisits = named.join(last, "_sha").where(F.col("_id") != F.col("_last")).select("_id", "_sha", "_last").distinct()
    dealt = keyed.join(revisits, ["_id", "_sha"], "left")  # ids are unique: an even shuffle of the payloads
    return cut_lineage(dealt.select("_id", "_url", "_payload", "_last").mapInArrow(_writer(root, file_bytes), INDEX))


# ------------------------------------------------------------------ reading

def ranges(index: pd.DataFrame, gap: int = GAP, most: int = RANGE) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """(start, end, records) of one file's selected records: sorted, close ones together."""
    index = index.sort_values("offset", kind="stable")
    starts, ends = index["offset"].to_numpy(), (index["offset"] + index["length"]).to_numpy()
    first = 0
    for k in range(1, len(index) + 1):
        if k == len(index) or starts[k] - ends[k - 1] > gap or ends[k] - starts[first] > most:
            yield int(starts[first]), int(ends[k - 1]), index.iloc[first:k]
            first = k


def _reader(root: str, with_payload: bool):
    def run(key, index: pd.DataFrame) -> pd.DataFrame:
        system, folder = location(root)
        out = []
        with system.open_input_file(f"{folder}/{key[0]}") as source:
            for start, end, rows in ranges(index):
                data = source.read_at(end - start, start)
                for r in rows.itertuples():
                    headers, body = parse(gzip.decompress(data[r.offset - start:r.offset - start + r.length]))
                    sha, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if sha != r.digest or kind != r.record_type or kind == "response" and digest(body) != sha:
                        raise ValueError(f"record at {key[0]}:{r.offset} differs from its index row")
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    out.append((page and int(page), headers.get("WARC-Target-URI"), int(headers["X-Payload-Length"]),
                                sha, kind, refers and int(refers),
                                body.decode() if with_payload and kind == "response" else None))
        frame = pd.DataFrame(out, columns=["_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                           "payload"])
        return frame.astype({"_id": "Int64", "refers_to": "Int64"})
    return run


def read(index: DataFrame, root: str, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """The records that ``index`` selects: id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A task reads one file's records at a time; files and ranges are of bounded size.
    """
    kind = "_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, " \
           "payload string"
    rows = index.select("file", "offset", "length", "digest", "record_type")
    return rows.groupBy("file").applyInPandas(_reader(root, with_payload), kind).withColumnRenamed("_id", id_col)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
