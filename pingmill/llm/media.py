"""Media columns: texts stored losslessly as grey 8-bit PNG images in archives, and read back by a data source of our own.

A payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64; its image is 64 pixels wide, one byte a pixel.
Archives are read by `media_source` (byte-range partitions, Arrow batches, retries by member); features come from the pixels read.

Defined results: null and empty texts are 64 zero bytes; equal texts give equal media, digests and features wherever they stand;
rows of equal doc_id are all kept; a null doc_id stays null; an empty table gives no archives and no rows; a long text is
compressed row block by row block; columns other than doc_id and the text are not read, and columns that describe adds get leading
underscores where their names are taken.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.llm import media_source
from pingmill.llm.common import fresh, new_path, ship, spread, table

WIDTH, ROWS, LEVEL = 64, 1 << 14, 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(WIDTH * max(1, -(-len(data) // WIDTH)) - len(data)), len(data)


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """A grey PNG of the bytes, 64 to a row; rows are stored without prediction."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    press, body = zlib.compressobj(LEVEL), []
    for at in range(0, len(pixels), ROWS):
        part = pixels[at : at + ROWS]
        body.append(press.compress(np.concatenate([np.zeros((len(part), 1), np.uint8), part], axis=1).tobytes()))
    body.append(press.flush())
    return SIGNATURE + _part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 0, 0, 0, 0)) + _part(b"IDAT", b"".join(body)) + _part(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The bytes of a PNG made by to_png; every checksum is verified."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], None
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"wrong checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("another kind of PNG")
    return rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean, deviation and entropy of the pixels, and a 64-bit mean hash of the image in 8 x 8 fields."""
    pixels = np.frombuffer(data, np.uint8)
    counts = np.bincount(pixels, minlength=256)
    share = counts[counts > 0] / len(pixels)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(pixels))
    spread = float(np.sqrt(max(0.0, (counts * values * values).sum() / len(pixels) - mean * mean)))
    image = pixels.reshape(-1, WIDTH)
    edges = np.linspace(0, len(image), 9).astype(int)
    columns = np.add.reduceat(image, np.arange(0, WIDTH, 8), axis=1, dtype=np.int64)
    sums = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    fields = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, (edges[1:] - edges[:-1]) * 8)[:, None]
    bits = np.packbits((fields > mean).ravel()).tobytes().hex()
    return f"mean={mean:.4f};sd={spread:.4f};entropy={-(share * np.log2(share)).sum():.4f};hash={bits}"


def write_archives(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Writes one archive a partition of docs(doc_id, text) under `path`; the lazy table of archives (file, members, bytes)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for doc_id, body in zip(batch.column("doc_id"), batch.column(text), strict=True):
                if archive is None:
                    archive = media_source.ArchiveWriter(path, f"part-{TaskContext.get().partitionId():06d}", uuid.uuid4().hex)
                data, n = payload(body.as_py())
                archive.add(doc_id.as_py(), to_png(data), n)
        if archive is not None:
            name, members, size = archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([members], pa.int64()), pa.array([size], pa.int64())], names=["file", "members", "bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "file string, members long, bytes long")


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    cloudpickle.register_pickle_by_value(media_source)
    try:
        spark.dataSource.register(media_source.MediaArchives)
    finally:
        cloudpickle.unregister_pickle_by_value(media_source)
    return spark.read.format("media_archives").options(**options).load(path)


def describe(archives: DataFrame, media: str = "media") -> DataFrame:
    """Rows of read_archives without the media, with what is computed from the bytes read."""
    ship(archives.sparkSession)
    rest = [c for c in archives.columns if c != media]
    names = fresh(archives, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = ("long", "string", "long", "long", "string", "string")
    schema = archives.select(*rest, *(F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True))).schema
    arrow = [pa.int64() if k == "long" else pa.string() for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(media):
                png = x.as_py()
                data = from_png(png)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(data)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, arrow, strict=True))], names=[*rest, *names])

    return archives.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    write_archives(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), path).agg(F.sum("members")).first()
    return describe(read_archives(spark, path)).drop("archive", "offset", "length")


def payload_digests(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op9's result: the payloads as they were read back from the archives."""
    return op9(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, octet_length(b) AS n, greatest(1, (octet_length(b) + 63) // 64) * 64 AS m FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(b || repeat('\x00'::BLOB, m - n)) AS payload_sha256 FROM p
"""
