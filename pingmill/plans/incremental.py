"""Products of a growing folder of CSV files, of which a run recomputes only the dates that new or changed files touch.

Under the output folder: `pings` (cleaned, with cells, partitioned by date and source file), mergeable products partitioned by date
(`night_counts`, `grid_daily`, `occupancy`, `daily_counts`), and `manifest`, a table of the source files as they were and the dates
that each holds. A run compares the folder with the manifest, rewrites the partitions of changed files, recomputes the touched dates
from them (all other partitions are neither read nor written), and adds a new version of the manifest last: a run that dies is
simply repeated. What needs several dates, as homes do, is merged from the stored parts.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.functions.cells import with_cells
from pingmill.operators import clean, contacts, homes, spatial, temporal
from pingmill.plans.pipeline import Config
from pingmill.sources import ingest

PRODUCTS = ("night_counts", "grid_daily", "occupancy", "daily_counts")
MANIFEST = "path string, length long, modified timestamp, source string, dates array<date>"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _drop(spark: SparkSession, path: str) -> None:
    store, p = _path(spark, path)
    store.delete(p, True)


def _versions(spark: SparkSession, out: str) -> list[int]:
    store, p = _path(spark, f"{out}/manifest")
    if not store.exists(p):
        return []
    found = [x.getPath() for x in store.listStatus(p)]
    done = [f for f in found if store.exists(_path(spark, f"{f.toString()}/_SUCCESS")[1])]
    return sorted(int(f.getName().removeprefix("version-")) for f in done)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """path, length, modified, source (its name in partitions), dates of the files that the products hold."""
    versions = _versions(spark, out)
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest/version-{versions[-1]}") if versions else spark.createDataFrame([], MANIFEST)


def source_of(path: Column) -> Column:
    """A name for a file in partitions, the same for both ways in which Spark writes a local path."""
    return F.substring(F.md5(F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")), 1, 16)


def _products(pings: DataFrame, config: Config) -> dict[str, DataFrame]:
    """All products of cleaned pings with cells, each with a column `date`."""
    known = pings.filter("date IS NOT NULL")
    at = F.date_from_unix_date(F.floor(F.col("bucket") / 86_400).cast("int"))
    return {
        "night_counts": homes.night_parts(known, config.night),
        "grid_daily": spatial.aggregate_grid(known, by_date=True),
        "occupancy": contacts.cell_occupancy(known, config.bucket).withColumn("date", at),
        "daily_counts": temporal.daily_counts(known),
    }


def update(spark: SparkSession, raw: str, out: str, config: Config = Config()) -> list[datetime.date]:
    """Brings the products under `out` up to date with the CSV files below `raw`; returns the dates that were recomputed.

    The bucket of occupancy must divide a day. Dates, files and their states are what the driver sees.
    """
    if 86_400 % contacts.seconds(config.bucket):
        raise ValueError(f"buckets of {config.bucket} cross midnight, so they are no products of one date")
    found = ingest.discover(spark, raw).select("path", "length", "modified", source_of(F.col("path")).alias("source"))
    before = manifest(spark, out)
    now = {r.source: r for r in found.collect()}
    old = {r.source: r for r in before.collect()}
    same = {s for s, r in now.items() if s in old and (old[s].length, old[s].modified) == (r.length, r.modified)}
    changed, gone = [s for s in now if s not in same], [s for s in old if s not in now]
    if not changed and not gone:
        return []
    pings_at = f"{out}/pings"
    dates: dict[str, list] = {s: [] for s in changed}
    for s in [*changed, *gone]:
        for d in [*old[s].dates, "__HIVE_DEFAULT_PARTITION__"] if s in old else ():
            _drop(spark, f"{pings_at}/date={d}/source={s}")
    if changed:
        file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        rows = ingest.raw_pings(spark, [now[s].path for s in changed]).withColumn("source", source_of(file))
        rows = with_cells(clean.clean_mobility(ingest.typed_pings(rows, "source")), config.index)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date", "source").parquet(pings_at)
        pings = _stored(spark, pings_at)
        for r in pings.filter(F.col("source").isin(changed)).groupBy("source").agg(F.sort_array(F.collect_set("date")).alias("dates")).collect():
            dates[r.source] = r.dates
    touched = sorted({d for x in dates.values() for d in x} | {d for s in [*changed, *gone] if s in old for d in old[s].dates})
    pings = _stored(spark, pings_at).filter(F.col("date").isin(touched))
    alive = {r.date for r in pings.select("date").distinct().collect()}
    for name, df in _products(pings, config).items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(f"{out}/{name}")
        for d in touched:  # a date that no file holds any more, or that has none of this product
            if d not in alive:
                _drop(spark, f"{out}/{name}/date={d}")
    state = [(r.path, r.length, r.modified, s, dates[s] if s in dates else old[s].dates) for s, r in now.items()]
    version = max(_versions(spark, out), default=0) + 1
    spark.createDataFrame(state, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/version-{version}")
    return touched


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("date", F.col("date").cast("date"))


def product(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A stored product; filters on date reach its partitions."""
    return _stored(spark, f"{out}/{name}")


def stored_homes(spark: SparkSession, out: str, config: Config = Config()) -> DataFrame:
    """Homes merged from the stored night counts of all dates."""
    return homes.homes_of(product(spark, out, "night_counts"), config.min_nights, config.index)
