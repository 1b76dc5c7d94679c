"""WARC archives: parallel writer with revisit records, and a splittable reader.

The writer gzips every record as a member of its own. The reader never needs an index: a
task gets a byte range of a file, scans it for gzip magic, accepts a candidate only if it decodes to WARC headers
and is followed by another member or the end of the file, and owns the records that start inside its range, however far they reach.

Files are opened by ``open_file``: plain files directly, other schemes by ``pyarrow.fs``.
Both sides work in tasks; the driver sees only the list of archives (one row per file).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.llm.common import land, scratch_path

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
CHAIN = 16  # members that must follow one another where a range starts inside a file
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes bigint, records bigint"
RECORD = ("path string, offset bigint, record_id string, record_type string, target_uri string, refers_to string, "
          "payload_digest string, payload_bytes bigint, payload binary")


def open_file(path: str, mode: str):
    """A binary file, in tasks and on the driver; parents are made when writing."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        local = "/" + rest.lstrip("/") if scheme == "file" else path
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if mode == "wb":
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


# ---------------------------------------------------------------- revisits

def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """Add body, digest (hex SHA-256), size and refers_to (the key of the response that a revisit repeats, else null).

    Of equal payloads of ``min_bytes`` or more the smallest key is the response. Null payloads are empty; null keys are
    never chosen while another key has the payload. Rows that repeat key and payload stay what the first one is.
    Only keys and digests are shuffled by digest; the groups meet as counts and minima.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col("url").cast("string").alias("url"), body.alias("body"),
                        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    long = rows.filter(F.col("size") >= min_bytes)
    groups = long.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    again = (long.select("key", "digest").distinct().join(groups.select("digest", "first"), "digest")
             .filter(~F.col("key").eqNullSafe(F.col("first"))))
    plain = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null keys join too
    again = again.select(plain("key").alias("k2"), F.col("digest").alias("d"), F.col("first").alias("refers_to"))
    return rows.withColumn("k", plain("key")).join(again, (F.col("k") == F.col("k2")) & (F.col("digest") == F.col("d")), "left").select(
        "key", "url", "body", "digest", "size", "refers_to")


# ---------------------------------------------------------------- writer

def _clean(value) -> str:
    """A header value stays on its line."""
    return "" if value is None else " ".join(str(value).split())


def _record(record_id: str, url: str, refers_to: str | None, digest: str, size: int, body: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + body
    kind = "revisit" if refers_to else "response"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http; msgtype=response"]
    if refers_to:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <{refers_to}>")
    head.append(f"Content-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write the rows of ``with_revisits`` as ``*.warc.gz`` below ``folder``; returns path, bytes and records per file.

    A file's name is new in every attempt, so a task that runs twice harms nothing: only files in the
    returned list count, and the list is written when all tasks are done.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, count, size, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for k, url, body, digest, n, first in batch.itertuples(index=False, name=None):
                if out is None:
                    out = open_file(path, "wb")
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                refers = f"urn:key:{first}" if isinstance(first, str) else None
                raw = _record(f"urn:key:{k if isinstance(k, str) else ''}", _clean(url), refers, digest, n, bytes(body))
                size += out.write(pack.compress(raw)) + out.write(pack.flush())
                count += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [count]})

    rows = records.select(F.col("key").cast("string"), "url", "body", "digest", "size", F.col("refers_to").cast("string"))
    return land(rows.mapInPandas(write, MANIFEST), "warc-manifest")


# ---------------------------------------------------------------- reader

class _Window:
    """The bytes of a file from a place on, read in blocks and dropped once passed."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data, self.ended = file, start, b"", False
        file.seek(start)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(BLOCK)
        self.ended = self.ended or not got
        self.data += got
        return bool(got)

    def skip_to(self, place: int) -> None:
        self.data = self.data[place - self.at:]
        self.at = place

    def find(self, place: int, end: int) -> int:
        """The first magic at or after ``place`` that starts before ``end``, else -1."""
        while place < end:
            hit = self.data.find(MAGIC, place - self.at)
            if hit >= 0:
                return self.at + hit if self.at + hit < end else -1
            place = max(place, self.at + len(self.data) - len(MAGIC) + 1)
            self.skip_to(min(place, self.at + len(self.data)))
            if not self.more():
                return -1
        return -1

    def starts_member(self, place: int) -> bool:
        """Whether a member, or the end of the file, is at ``place``."""
        while len(self.data) < place - self.at + len(MAGIC) and self.more():
            pass
        rest = self.data[place - self.at:place - self.at + len(MAGIC)]
        return not rest or rest == MAGIC


def _member(w: _Window, place: int) -> tuple[bytes, int] | None:
    """The content of the member at ``place`` and its end; None if it is no WARC record."""
    unpack, out, at, begun, checked = zlib.decompressobj(31), [], place, False, False
    while not unpack.eof:
        while at >= w.at + len(w.data):
            if not w.more():
                return None
        chunk = w.data[at - w.at:at - w.at + (BLOCK if begun else 4096)]
        try:
            out.append(unpack.decompress(chunk))
        except zlib.error:
            return None
        at += len(chunk) - len(unpack.unused_data)
        if not checked:
            head = b"".join(out)
            if not b"WARC/".startswith(head[:5]):
                return None
            out, begun, checked = [head], len(head) >= 5, b"\r\n\r\n" in head  # headers are read to their end, however long
    return (b"".join(out), at) if checked else None


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _parsed(path: str, offset: int, raw: bytes) -> tuple | None:
    """One row of RECORD; None if the headers don't describe the content."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    if not h.get("content-length", "").isdigit() or int(h["content-length"]) > len(rest) or "warc-type" not in h:
        return None
    block = rest[:int(h["content-length"])]
    size, payload = len(block), block
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = _headers(http).get("content-length", "")
        size = int(said) if said.isdigit() else len(payload)
    bare = lambda v: v.strip("<>") if v else None
    return (path, offset, bare(h.get("warc-record-id")), h["warc-type"], h.get("warc-target-uri"), bare(h.get("warc-refers-to")),
            (h.get("warc-payload-digest") or "").rpartition(":")[2] or None, size, payload if h["warc-type"] != "revisit" else None)


def _chained(path: str, place: int, end: int) -> bool:
    """Whether members follow one another from ``place`` on: to ``end``, to the end of the file, or ``CHAIN`` of them."""
    with open_file(path, "rb") as file:
        w = _Window(file, place)
        for _ in range(CHAIN):
            got = _member(w, place)
            if got is None or _parsed(path, place, got[0]) is None or not w.starts_member(got[1]):
                return False
            place = got[1]
            w.skip_to(min(place, w.at + len(w.data)))
            if place >= end or w.ended and place >= w.at + len(w.data):
                return True
    return True


def records_in(path: str, start: int, end: int) -> Iterator[tuple]:
    """The records that start in ``[start, end)`` of a file.

    Inside a file the first candidate must begin a chain of members, so that an archive stored within a
    payload is not taken for records (unless it holds ``CHAIN`` members or reaches the end of the range).
    """
    with open_file(path, "rb") as file:
        w, place, sure = _Window(file, start), start, start == 0
        while (at := w.find(place, end)) >= 0:
            w.skip_to(at)
            sure = sure and at == place or _chained(path, at, end)
            got = _member(w, at) if sure else None
            row = _parsed(path, at, got[0]) if got else None
            sure = row is not None
            place = got[1] if row else at + 1
            w.skip_to(min(place, w.at + len(w.data)))
            if row:
                yield row


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives in ``manifest`` (path, bytes), one task item per ``split_bytes`` of a file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for path, start, end in batch.itertuples(index=False, name=None):
                rows, held = [], 0
                for row in records_in(path, start, end):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > 4 * BLOCK:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    ranges = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split_bytes)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInPandas(read, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, level: int = 3, split_bytes: int = 8 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and return the records read back from them.

    Any null, empty or repeated row makes a record; an empty table makes no archive and gives no records. An archive that gives
    another number of records than were written to it is an error.
    """
    manifest = write_archives(with_revisits(pages), scratch_path(spark, "warc"), level)
    records = read_archives(spark, manifest, split_bytes)
    counted = records.groupBy("path").agg(F.count("*").alias("found"))
    wrong = manifest.join(counted, "path", "left").filter(F.coalesce("found", F.lit(0)) != F.col("records")).select("path", "records", "found").take(5)
    if wrong:
        raise ValueError(f"archives with lost records: {wrong}")
    return records
