"""CSV files of unknown dialects: delimiter, quote, header and types are detected from samples of every file and read alike.

Executors read the beginning of each file. A dialect is the one under which most lines of the sample have the same number of fields
(two or more; ties go to more fields, then to the order below). The first line is a header where none of its fields is a number and
a field below one is, or where its fields come again as a line. Types are voted over all files: a column is as wide as the widest
file needs it, a file counting a type only if nearly all of its values have it, so single bad values do not turn numbers into text.

Files of one dialect are read by one scan; scans meet by column name. Repeated header lines are left out, and so are rows with a
value that does not have its column's type; missing values are null.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.sources.ingest import open_store

DELIMITERS, QUOTES = (",", ";", "\t", "|"), ('"', "'")
#: Bytes of a file that are looked at, and the share of a file's values that must have a type.
SAMPLE, SHARE = 1 << 16, 0.9
TYPES = ("bigint", "double", "timestamp", "string")
MISSING = ("", "\\N", "NA", "null", "NULL")


def _kind(value: str) -> int:
    for k, make in enumerate((int, float, datetime.fromisoformat)):
        try:
            make(value)
        except ValueError:
            continue
        # Python is laxer than Spark about signs of digits such as 1_000.
        if "_" not in value:
            return k
    return len(TYPES) - 1


def sniff(text: str, cut: bool = False) -> tuple[str, str, bool, list[str], list[str]] | None:
    """(delimiter, quote, header, column names, types) of a sample; cut: whether its last line may be incomplete. None for an empty one."""
    lines = text.splitlines()
    lines = [x for x in (lines[:-1] if cut and len(lines) > 1 else lines) if x.strip()]
    if not lines:
        return None
    best, rows = None, []
    for k, (d, q) in enumerate((d, q) for d in DELIMITERS for q in QUOTES):
        parsed = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=d, quotechar=q))
        (fields, n), *_ = sorted(Counter(map(len, parsed)).items(), key=lambda x: (-x[1], -x[0]))
        quoted = sum(1 for r in parsed for v in r for o in QUOTES if len(v) > 1 and v[0] == v[-1] == o)  # quotes that were left standing
        score = (fields > 1, n / len(parsed), -quoted, fields, -k)
        if best is None or score > best[0]:
            best, rows, width, delimiter, quote = (score,), [r for r in parsed if len(r) == fields], fields, d, q
    first = rows[0]
    later = [r for r in rows[1:] if r != first] or rows[1:] or rows  # a header that comes again has no vote
    kinds = []
    for c in range(width):
        body = [_kind(v) for v in (r[c].strip() for r in later) if v not in MISSING]
        fit = [k for k in range(len(TYPES)) if sum(x <= k if k == 1 else x == k for x in body) >= SHARE * max(1, len(body))]
        kinds.append(fit[0] if fit and body else len(TYPES) - 1)
    header = all(_kind(v.strip()) == len(TYPES) - 1 and v.strip() not in MISSING for v in first) and (any(k < len(TYPES) - 1 for k in kinds) or first in rows[1:])
    return delimiter, quote, header, [v.strip() for v in first] if header else [], [TYPES[k] for k in kinds]


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri in batch.column("path").to_pylist():
            store, path = open_store(uri)
            with store.open_input_stream(path, compression=None) as f:
                head = f.read(SAMPLE)
            text = head.decode("utf-8-sig", "ignore")
            found.append((uri, *(sniff(text, len(head) == SAMPLE) or (None, None, None, None, None))))
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["path", "delimiter", "quote", "header", "columns", "types"])


def detect(spark: SparkSession, folder: str, glob: str = "*.[cC][sS][vV]") -> DataFrame:
    """path, delimiter, quote, header, columns, types of the files below a folder; all null for files without a line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path")
    return files.repartition("path").mapInArrow(_detect, "path string, delimiter string, quote string, header boolean, columns array<string>, types array<string>")


def read_csv_auto(spark: SparkSession, folder: str, names: Sequence[str] | None = None, glob: str = "*.[cC][sS][vV]") -> DataFrame:
    """All rows of the files below a folder, whatever their dialects. names: of the columns of files without a header, in order
    (column0, column1, ... by default). One row a file comes to the driver."""
    found = [r for r in detect(spark, folder, glob).collect() if r.delimiter is not None]
    if not found:
        raise ValueError(f"no lines in the files below {folder}")
    groups: dict[tuple, list[str]] = {}
    widest: dict[str, int] = {}
    for r in found:
        columns = tuple(r.columns) if r.header else tuple((names or ())[: len(r.types)]) + tuple(f"column{k}" for k in range(len(names or ()), len(r.types)))
        groups.setdefault((r.delimiter, r.quote, r.header, columns), []).append(r.path)
        for c, t in zip(columns, r.types, strict=True):
            k, old = TYPES.index(t), widest.get(c)
            widest[c] = k if old is None or old == k else max(old, k) if max(old, k) == 1 else len(TYPES) - 1
    out = None
    for (delimiter, quote, header, columns), paths in sorted(groups.items()):
        raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", delimiter).option("quote", quote).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(paths)
        same = F.lit(bool(columns))
        for c in columns:
            same = same & F.col(f"`{c}`").eqNullSafe(F.lit(c))
        value = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.trim(F.col(f"`{c}`"))) for c in columns}
        cast = {c: value[c].try_cast(TYPES[widest[c]]) for c in columns}
        fine = ~same
        for c in columns:
            fine = fine & (value[c].isNull() | cast[c].isNotNull())
        part = raw.filter(fine).select(*(cast[c].alias(c) for c in columns))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
