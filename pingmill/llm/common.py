"""What the operators of this folder share: the shared folder, written tables, code shipping, text batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words, as a regular expression for a word.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that executors need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="pingmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "pingmill_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)


_memories: dict[str, Callable[[], None]] = {}
_latest: list[str] = []


def _give_back() -> None:
    """Returns freed memory to the system: the allocators of Arrow and of C keep it otherwise, and the next operator's comes on top."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def turn_to(operator: str, release: Callable[[], None] | None = None) -> None:
    """Called by tasks: a Python worker that turns to another operator lets go of what the former one kept from task to task.

    release: how to let go of what this one is about to keep.
    """
    for name in [n for n in _memories if n != operator]:
        _memories.pop(name)()
    if _latest != [operator]:
        _latest[:] = [operator]
        _give_back()
    if release:
        _memories[operator] = release


def spread(df: DataFrame) -> DataFrame:
    """A plain scan's rows dealt over all cores where its files have fewer splits than those (a file of one row group is one split)."""
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    most, path = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes(), spark._jvm.org.apache.hadoop.fs.Path
    sizes = [path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(f)).getLen() for f in files]
    return df.repartition(cores) if sum(-(-n // most) for n in sizes) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir; only where that is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "pingmill")
        os.makedirs(found[7:], exist_ok=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It goes when the driver ends, or earlier by discard()."""
    path = f"{shared_dir(spark).rstrip('/')}/pingmill-{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session has ended: nothing is left to delete with
            return


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it back. This cuts the lineage: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def popcount_le(a: Column, b: Column, mask: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(mask)) <= most


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about `most` bytes each: bounds what a step holds beside the batch."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)] if batch.num_rows < 64 else None
    if sizes is None:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield start, batch.num_rows


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


Query = Callable[[SparkSession, str], DataFrame]


#: Two characters of Unicode white space (or of the ASCII separators) in a row.
DOUBLE_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"


def encode_by_chunks(texts: pa.Array, chunks: Callable[[list[str], bool], list[bytes]], whole: Callable[[str], bytes]) -> list[bytes]:
    """Encodes texts whose codes do not reach over a space between two other characters.

    Arrow cuts the texts at spaces and numbers the distinct chunks; `chunks(distinct, first)` encodes those once (as they are if
    first, else after a space), and Arrow puts the codes in order. Texts with two spaces in a row go to `whole`.
    """
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, DOUBLE_SPACE)
    lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    out: list[bytes] = []
    if len(lists):
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        later, first = flat.dictionary_encode(), flat.take(pa.array(bounds[:-1])).dictionary_encode()
        at = later.indices.to_numpy().astype(np.int64)
        at[bounds[:-1]] = len(later.dictionary) + first.indices.to_numpy()
        codes = chunks(later.dictionary.to_pylist(), False) + chunks(first.dictionary.to_pylist(), True)
        done = pa.array(codes, pa.large_binary()).take(pa.array(at))
        _, offsets, data = done.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(done) + 1][bounds].tolist()
        view = memoryview(data) if data is not None else b""
        out = [bytes(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    if len(out) == len(texts):
        return out
    rest, plain = iter(out), odd.to_pylist()
    return [whole(t.as_py()) if o else next(rest) for t, o in zip(texts, plain, strict=True)]
