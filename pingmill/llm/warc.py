"""WARC archives: writing with revisit records, and reading as a table of chunks.

Writing: payloads are digested in the JVM; for each digest the record with the largest id is the response and all others are
revisits of it. Payloads reach the writers as chunk rows of at most `CHUNK` bytes (revisits without any), which are compressed and
digested one by one; a payload whose bytes disagree with its digest stops the write. Tasks write one gzip member a record into
files of the shared folder and return a table of segments (file, offset, length); only segments of successful tasks are in that
table, so a lost executor leaves at most files that nobody reads.

Reading: a task streams its segments through a decompressor and emits rows (record, chunk number, chunk), each with the bytes and
the SHA-1 so far. No payload is ever held whole: a record of any size is a sequence of rows of at most `CHUNK` bytes, and the row
marked `last` carries the digest of all of it. A response whose bytes disagree with its stated digest or length stops the read.

Defined results: null html is the empty payload; a null url has no WARC-Target-URI; rows of equal id that are the largest of their
digest are all responses; null ids are written as such and revisit any other; payloads under `least` bytes are always responses;
an empty table gives no segments and no rows; columns other than page_id, url and html are not read, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.llm.common import new_path, ship, table, written
from pingmill.llm.media_source import open_store

CHUNK, SEGMENT, BLOCK = 1 << 20, 8 << 20, 1 << 16
LEAST = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_ROWS = "page_id long, record_type string, refers_to long, chunk_no long, bytes_so_far long, sha1_so_far string, last boolean, chunk binary"


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) with sha1 (hex), and `response` (the id of the digest's response; null: it is the only one)."""
    body = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body")).withColumn("sha1", F.sha1("body"))
    shared = rows.filter(F.length("body") >= least).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared, _ = written(shared, "shared-payloads")  # a plain table: Spark splits the join's skewed side, or broadcasts it by its size
    return rows.join(shared, "sha1", "left").withColumn("response", F.when(F.length("body") >= least, F.col("response")))


def record_chunks(rows: DataFrame) -> DataFrame:
    """Rows of `roles` as chunk rows: page_id, url, sha1, response, size, chunk_no, last, chunk. A record's rows follow each other."""
    size = F.length("body")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    count = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(size / CHUNK))).cast("int")
    each = rows.select("page_id", "url", "sha1", "response", "body", size.cast("long").alias("size"), revisit.alias("revisit"), count.alias("count"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("chunk_no"))
    chunk = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring("body", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)))
    return each.select("page_id", "url", "sha1", "response", "size", "revisit", "chunk_no", (F.col("chunk_no") == F.col("count") - 1).alias("last"), chunk.alias("chunk"))


def record_head(page_id: int | None, url: str | None, size: int, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record up to its payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return ("\r\n".join(head) + "\r\n\r\n" + http).encode()


class RecordWriter:
    """Writes chunk rows as gzip members, one a record, to a stream; segments tells where about `SEGMENT` bytes of them lie."""

    def __init__(self, out, level: int):
        self.out, self.level = out, level
        self.at = self.start = 0
        self.segments: list[tuple[int, int]] = []

    def add(self, page_id: int | None, url: str | None, sha1: str, response: int | None, size: int, revisit: bool, chunk_no: int, last: bool, chunk: bytes) -> None:
        if chunk_no == 0:
            self.press, self.digest = zlib.compressobj(self.level, zlib.DEFLATED, 31), hashlib.sha1()
            self._put(self.press.compress(record_head(page_id, url, size, sha1, response, revisit)))
        self.digest.update(chunk)
        self._put(self.press.compress(chunk))
        if last:
            if not revisit and self.digest.hexdigest() != sha1:
                raise ValueError(f"record {page_id}: its payload has SHA-1 {self.digest.hexdigest()}, not {sha1}")
            self._put(self.press.compress(b"\r\n\r\n") + self.press.flush())
            if self.at - self.start >= SEGMENT:
                self.cut()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def cut(self) -> None:
        if self.at > self.start:
            self.segments.append((self.start, self.at - self.start))
            self.start = self.at


def write_archives(rows: DataFrame, path: str, level: int = 4) -> DataFrame:
    """Writes rows of `roles` as WARC files under `path`; the lazy table of their segments."""
    ship(rows.sparkSession)
    columns = ("page_id", "url", "sha1", "response", "size", "revisit", "chunk_no", "last", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        name, writer = f"{root}/{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            for k in range(batch.num_rows):
                writer = writer or RecordWriter(store.open_output_stream(name, compression=None), level)
                writer.add(*(batch.column(c)[k].as_py() for c in columns))
        if writer is not None:
            writer.out.close()
            writer.cut()
            found = writer.segments
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["file", "offset", "length"])

    return record_chunks(rows).select(*columns).mapInArrow(run, "file string, offset long, length long")


class _Members:
    """Reads a byte range of a file as a stream of gzip members' contents."""

    def __init__(self, stream, length: int):
        self.stream, self.left, self.rest = stream, length, b""
        self.press = zlib.decompressobj(31)
        self.ready = b""

    def more(self) -> bool:
        """Decompresses one more step of the current member; false at its end."""
        if self.press.eof:
            return False
        data = self.press.unconsumed_tail or self.rest
        if not data:
            data = self.stream.read(min(BLOCK, self.left))
            self.left -= len(data)
            if not data:
                raise EOFError("a WARC segment ends inside a record")
        self.rest = b""
        self.ready += self.press.decompress(data, CHUNK)
        if self.press.eof:
            self.rest = self.press.unused_data
        return True

    def following(self) -> bool:
        """Moves on to the next member, if there is one."""
        while self.more():
            self.ready = b""
        if not self.rest and self.left <= 0:
            return False
        self.press, self.ready = zlib.decompressobj(31), b""
        return True

    def head(self) -> dict[str, str]:
        while b"\r\n\r\n" not in self.ready:
            if not self.more():
                raise EOFError("a WARC record without headers")
        text, self.ready = self.ready.split(b"\r\n\r\n", 1)
        lines = text.decode("utf-8", "replace").split("\r\n")
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        out, self.ready = self.ready[:n], self.ready[n:]
        if len(out) < n:
            raise EOFError("a WARC record ends inside its payload")
        return out


def chunks(stream, length: int, keep: bool = True) -> Iterator[tuple]:
    """Rows of the chunk table for one segment."""
    members = _Members(stream, length)
    number = lambda x: None if x == "None" else int(x)
    while True:
        warc = members.head()
        page, kind = number(warc["warc-record-id"][10:-1]), warc["warc-type"]
        http = members.head()
        total, stated = int(http["content-length"]), warc["warc-payload-digest"].partition(":")[2]
        if kind == "revisit":
            yield page, kind, number(warc["warc-refers-to"][10:-1]), 0, total, stated, True, b"" if keep else None
        else:
            sha1, done, k = hashlib.sha1(), 0, 0
            while True:
                part = members.take(min(CHUNK, total - done))
                sha1.update(part)
                done += len(part)
                so_far = base64.b32encode(sha1.copy().digest()).decode()
                last = done == total
                if last and so_far != stated:
                    raise ValueError(f"record {page}: its payload has digest {so_far}, its header {stated}")
                yield page, kind, None, k, done, so_far, last, part if keep else None
                if last:
                    break
                k += 1
        if not members.following():
            return


def chunk_table(segments: DataFrame, keep: bool = True) -> DataFrame:
    """The chunk table of all records in the segments. keep: with the chunks themselves."""
    ship(segments.sparkSession)
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                store, name = open_store(s["root"])[0], s["file"]
                with store.open_input_file(name) as f:
                    f.seek(s["offset"])
                    rows, size = [], 0
                    for row in chunks(f, s["length"], keep):
                        rows.append(row)
                        size += len(row[-1] or b"") + 100
                        if size >= 2 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(parts, "file", "offset").mapInArrow(run, _ROWS)


def archive(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Writes pages as WARC archives under `path` and returns the written table of segments (root, file, offset, length)."""
    segments, _ = written(write_archives(roles(pages, least), path).withColumn("root", F.lit(path)), "segments")
    return segments


def op10(spark, sf_dir: str) -> DataFrame:
    segments = archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    rows = chunk_table(segments, keep=False).filter("last")
    return rows.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")




#: Base 32 of a SHA-1 in hexadecimal digits: five of them are four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, {1 + 5 * (i // 4)}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31) AS INT), 1)" for i in range(32)
)
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM r
"""
