"""Mergeable exact distinct counts: devices as numbers, and their sets as stored bitmaps.

`dictionary` numbers the devices densely. `parts` holds, for each bucket and cell, one bitmap for each 32,768 device numbers that
occur (4 KB, nearly all zeros where cells are sparse, which the Parquet codec takes out). Bitmaps of the same numbers merge by OR, so
coarser buckets, days or larger areas are counted from stored parts, exactly and without reading pings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.operators.contacts import seconds
from pingmill.operators.temporal import bucket

#: Groups in which devices are numbered side by side.
GROUPS = 256


def dictionary(pings: DataFrame, known: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """maid, device: a number from 1 on for each device. The numbers follow from the names alone, so they can be computed twice.

    known: an earlier dictionary, whose numbers stay; new devices get the numbers after its greatest.
    """
    names = pings.filter("maid IS NOT NULL").select("maid").distinct()
    start = F.lit(0)
    if known is not None:
        names = names.join(known, "maid", "left_anti")
        start = F.lit(known.agg(F.coalesce(F.max("device"), F.lit(0))).first()[0])
    names = names.withColumn("_g", F.pmod(F.xxhash64("maid"), F.lit(groups)))
    sizes = names.groupBy("_g").agg(F.count("*").alias("_n"))
    before = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)  # a row a group
    sizes = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_g").orderBy("maid"))
    new = names.withColumn("_k", place).join(sizes, "_g").select("maid", (start + F.col("_before") + F.col("_k")).cast("long").alias("device"))
    return new if known is None else known.select("maid", "device").unionByName(new)


def parts(pings: DataFrame, devices: DataFrame, width: str = "1h", cell: str = "cell") -> DataFrame:
    """bucket, cell, part, bits, n_pings: the devices of each bucket and cell as bitmaps. Pings without a device count as pings only."""
    rows = pings.filter("timestamp IS NOT NULL").select("maid", bucket(F.col("timestamp"), seconds(width)).alias("bucket"), F.col(cell).alias("cell"))
    rows = rows.groupBy("maid", "bucket", "cell").agg(F.count("*").alias("n")).join(devices, "maid", "left")
    return rows.groupBy("bucket", "cell", F.bitmap_bucket_number("device").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("device")).alias("bits"), F.sum("n").alias("n_pings"))


def merge(stored: DataFrame, *keys) -> DataFrame:
    """Parts of coarser keys (columns of the stored parts): keys, part, bits, n_pings. The result merges on."""
    return stored.groupBy(*keys, "part").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n_pings").alias("n_pings"))


def counts(stored: DataFrame, *keys) -> DataFrame:
    """keys, n_devices, n_pings."""
    names = stored.select(*keys).columns
    return merge(stored, *keys).groupBy(*names).agg(F.sum(F.bitmap_count("bits")).alias("n_devices"), F.sum("n_pings").alias("n_pings"))


def occupancy(stored: DataFrame, width: str) -> DataFrame:
    """Devices and pings by wider buckets and cell; `width` must be a multiple of the stored parts' width."""
    return counts(stored, bucket(F.col("bucket"), seconds(width)).alias("bucket"), "cell")


def daily(stored: DataFrame) -> DataFrame:
    """Devices and pings by date over all cells; the stored width must divide a day."""
    return counts(stored, F.date_from_unix_date(F.floor(F.col("bucket") / 86_400).cast("int")).alias("date"))
