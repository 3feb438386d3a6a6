"""A Spark data source for directories of media archives. Self-contained: Spark ships it to workers by value.

An archive is its members' bytes, then a directory of fixed-width entries in member order, then a footer. Its name tells how many
members there are and where the directory begins, so planning lists names only and cuts each directory into byte ranges of about
`target` bytes of members; it opens no archive (but such as are named otherwise, several at a time) and never lists members. A
task checks the footer, reads its slice of the directory and streams the members through Arrow in batches of about `batch` bytes. A
member whose read fails or whose checksum is wrong is read again by its own offset, up to `retries` times, without touching its
neighbours.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "<?qQQIQ"  # has id, id, offset, length, crc32, bytes before padding
FOOTER = "<8sQQ"  # magic, members, where the directory begins
MAGIC = b"MEDIAARC"
SUFFIX = ".arc"
FIGURES = re.compile(r"\.m(\d+)\.d(\d+)\.arc$")
SCHEMA = "doc_id long, n_bytes long, archive string, offset long, length long, media binary"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a URI as Hadoop writes it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", uri)))


class ArchiveWriter:
    """Writes one archive under a temporary name; close() gives it its final name, so unfinished ones are never read.

    The final name comes from the partition and the archive's figures: a task that runs twice writes the same archive twice.
    """

    def __init__(self, root_uri: str, name: str, attempt: str):
        self.store, self.root = open_store(root_uri)
        self.store.create_dir(self.root, recursive=True)
        self.temporary, self.name = f"{self.root}/_{attempt}", f"{self.root}/{name}"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.at, self.entries = 0, []

    def add(self, doc_id: int | None, media: bytes, n_bytes: int) -> None:
        self.out.write(media)
        self.entries.append(struct.pack(ENTRY, doc_id is not None, doc_id or 0, self.at, len(media), zlib.crc32(media), n_bytes))
        self.at += len(media)

    def close(self) -> tuple[str, int, int]:
        self.out.write(b"".join(self.entries))
        self.out.write(struct.pack(FOOTER, MAGIC, len(self.entries), self.at))
        self.out.close()
        self.final = f"{self.name}.m{len(self.entries)}.d{self.at}{SUFFIX}"
        try:
            self.store.move(self.temporary, self.final)
        except OSError:
            # A store that renames onto nothing only: another attempt has put the same archive there already.
            if self.store.get_file_info(self.final).type == fs.FileType.NotFound:
                raise
            self.store.delete_file(self.temporary)
        return self.final, len(self.entries), self.at


class Slice(InputPartition):
    def __init__(self, path: str, first: int, count: int, directory: int):
        self.path, self.first, self.count, self.directory = path, first, count, directory


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.target = int(options.get("target", 8 << 20))
        self.batch = int(options.get("batch", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Slice]:
        store, root = open_store(self.uri)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return [Slice("", 0, 0, 0)]
        files = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(SUFFIX)]
        # Of one partition's archives (a task that ran twice on rows in another order) the last one counts.
        latest = {FIGURES.sub("", x.path): x for x in sorted(files, key=lambda x: (x.mtime_ns or 0, x.path))}
        files = sorted(latest.values(), key=lambda x: x.path)
        with ThreadPoolExecutor(16) as pool:
            figures = list(pool.map(lambda x: self._figures(store, x.path), files))
        out = []
        for info, (members, directory) in zip(files, figures, strict=True):
            step = max(1, members * self.target // max(1, directory))
            out += [Slice(info.path, k, min(step, members - k), directory) for k in range(0, members, step)]
        return out or [Slice("", 0, 0, 0)]

    def _figures(self, store, path: str) -> tuple[int, int]:
        named = FIGURES.search(path)
        if named:
            return int(named[1]), int(named[2])
        with store.open_input_file(path) as f:
            return self._footer(f, path)

    @staticmethod
    def _footer(f, path: str) -> tuple[int, int]:
        f.seek(f.size() - struct.calcsize(FOOTER))
        magic, members, directory = struct.unpack(FOOTER, f.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a media archive")
        return members, directory

    def member(self, store, path: str, f, offset: int, length: int, crc: int) -> bytes:
        """One member by its offset; a failed attempt opens the file anew."""
        for attempt in range(self.retries + 1):
            try:
                if attempt:
                    f = store.open_input_file(path)
                f.seek(offset)
                data = f.read(length)
                if len(data) == length and zlib.crc32(data) == crc:
                    return data
                reason: object = "wrong checksum"
            except OSError as e:
                reason = e
        raise OSError(f"{path}: the member at {offset} could not be read in {self.retries + 1} attempts: {reason}")

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = open_store(self.uri)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        with store.open_input_file(partition.path) as f:
            members, directory = self._footer(f, partition.path)
            if directory != partition.directory or partition.first + partition.count > members:
                raise ValueError(f"{partition.path} is not the archive that its name tells of")
            f.seek(partition.directory + partition.first * struct.calcsize(ENTRY))
            entries = f.read(partition.count * struct.calcsize(ENTRY))
            rows, size = [], 0
            for has_id, doc_id, offset, length, crc, n_bytes in struct.iter_unpack(ENTRY, entries):
                rows.append((doc_id if has_id else None, n_bytes, partition.path, offset, length, self.member(store, partition.path, f, offset, length, crc)))
                size += length
                if size >= self.batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(uri); options target, batch, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)
