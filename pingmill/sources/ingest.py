"""Raw files to Parquet: pings with leaked headers and bad rows, headerless profiles, months of parts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.operators.clean import MISSING, clean_mobility, clean_people
from pingmill.sources.schemas import PEOPLE, PEOPLE_COLUMNS, PING, RAW_PING

PART = r"(?i)^(.+)_part\d+$"
BLOCK = 8 << 20


def read_pings_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Typed pings of CSV files with a header. All columns are read as text and cast here: rows are then the same whichever columns a query asks for."""
    return typed_pings(raw_pings(spark, paths))


def raw_pings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(RAW_PING).option("header", True).option("mode", "PERMISSIVE").csv(paths if isinstance(paths, str) else list(paths))


def typed_pings(raw: DataFrame, *more: str) -> DataFrame:
    """Rows of text columns, batch or stream, cast: repeated headers and rows with a value that cannot be read go, missing values are null."""
    raw = raw.filter(F.coalesce(F.col("timestamp"), F.lit("")) != "timestamp")
    typed = {"latitude": "double", "longitude": "double", "timestamp": "long"}
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    cast = {c: blank(F.col(c)).try_cast(t) for c, t in typed.items()}
    fine = None
    for c in typed:
        ok = blank(F.col(c)).isNull() | cast[c].isNotNull()
        fine = ok if fine is None else fine & ok
    return raw.filter(fine).select("maid", *(cast[c].alias(c) for c in typed), *more)


def mobility_csvs_to_parquet(spark: SparkSession, paths: str | Sequence[str], out: str) -> None:
    read_pings_csv(spark, paths).write.mode("overwrite").option("compression", "zstd").parquet(out)


mobility_csv_to_parquet = mobility_csvs_to_parquet


def people_csv_to_parquet(spark: SparkSession, path: str, out: str, columns: Sequence[str] = PEOPLE_COLUMNS) -> None:
    schema = PEOPLE if tuple(columns) == PEOPLE_COLUMNS else ", ".join(f"{c} string" for c in columns)
    raw = spark.read.schema(schema).option("header", False).option("nullValue", MISSING).csv(path)
    raw.write.mode("overwrite").option("compression", "zstd").parquet(out)


def load_mobility(spark: SparkSession, paths: str | Sequence[str], geom: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if columns:
        df = df.select(*columns)
    df = clean_mobility(df)
    return df.withColumn("geometry", F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))) if geom else df


def load_people(spark: SparkSession, path: str) -> DataFrame:
    """Profiles with their place in the files as profile_no, so that a device's first row stays the first."""
    df = spark.read.parquet(path).withColumn("profile_no", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return clean_people(df)


def inspect_csv(spark: SparkSession, path: str, header: bool = True, n: int = 5) -> DataFrame:
    return spark.read.option("header", header).option("inferSchema", True).csv(path).limit(n)


def date_range(pings: DataFrame, first: str, last: str) -> DataFrame:
    """Pings from the first to the last date: a range of Unix times, which reaches the Parquet scan."""
    edge = lambda d, days: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(DATE'{d}' + {days} AS TIMESTAMP_NTZ))")
    return pings.filter((F.col("timestamp") >= edge(first, 0)) & (F.col("timestamp") < edge(last, 1)))


def month_key(stem: Column) -> Column:
    return F.regexp_replace(stem, PART, "$1")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path -> SHA-256 of the file, read in blocks: files of any size."""
    for batch in batches:
        found = []
        for uri in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            store, path = open_store(uri)
            with store.open_input_stream(path, compression=None) as f:
                while block := f.read(BLOCK):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "digest"])


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a URI as Hadoop writes it."""
    uri = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    return fs.FileSystem.from_uri(uri)


def discover(spark: SparkSession, folder: str, skip: Sequence[str] = ("people", "people_graph")) -> DataFrame:
    """path, length, modified, digest, month of the CSV files below a folder; of byte-identical files only the first path.

    Listing is Spark's own. Only files of equal length are read for a digest, on the executors and in blocks; others have none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    rows = files.select("path", "length", F.col("modificationTime").alias("modified"), month_key(stem).alias("month"), F.lower(stem).alias("stem"))
    rows = rows.filter(~F.col("stem").isin([s.lower() for s in skip])).drop("stem")
    alike = rows.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length")
    digests = rows.join(alike, "length", "left_semi").select("path").repartition("path").mapInArrow(_digests, "path string, digest string")
    known = rows.join(digests, "path", "left")
    first = known.groupBy("length", "digest").agg(F.min("path").alias("path"))
    return known.join(first.select("path"), "path", "left_semi")


def _modified(spark: SparkSession, path: str) -> int:
    """Modification time in ms of the newest thing at a path; -1 if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return fs.getFileStatus(done).getModificationTime() if fs.exists(done) else -1


def convert_tree(spark: SparkSession, raw: str, out: str, force: bool = False) -> list[str]:
    """One Parquet table a month under out/, for months with a source newer than the table; returns the months written.

    The list of months is driver-side (a few rows); all rows stay on the executors. Read out/* for the combined table.
    """
    months = discover(spark, raw).groupBy("month").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.max(F.unix_millis("modified")).alias("newest")).collect()
    made = []
    for m in sorted(months, key=lambda r: r["month"]):
        target = f"{out}/{re.sub(r'[^A-Za-z0-9_.-]', '_', m['month'])}"
        if force or _modified(spark, target) < m["newest"]:
            mobility_csvs_to_parquet(spark, m["paths"], target)
            made.append(m["month"])
    return made


def convert_glob(spark: SparkSession, paths: str | Sequence[str], out: str) -> DataFrame:
    """One folder a source file under out/ (file=<name without its ending>), written by a single job; returns the combined table."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    raw = raw_pings(spark, paths).withColumn("file", name)
    typed_pings(raw, "file").write.mode("overwrite").option("compression", "zstd").partitionBy("file").parquet(out)
    return spark.read.schema(f"{PING}, file string").parquet(out)


def combined(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*paths)
