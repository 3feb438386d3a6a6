"""Who is where at the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.operators.temporal import bucket

THRESHOLDS = (2, 5, 10, 20)
UNITS = {"s": 1, "min": 60, "h": 3600, "d": 86400}


def seconds(width: str) -> int:
    """'1h', '30min', '7h', '2D' in seconds."""
    digits = "".join(c for c in width if c.isdigit()) or "1"
    return int(digits) * UNITS[width[len(digits) if width[0].isdigit() else 0 :].lower()]


def cell_occupancy(pings: DataFrame, width: str = "1h", cell: str = "cell") -> DataFrame:
    """Distinct devices and pings by (bucket, cell). One global aggregate: right for any width, also across midnight."""
    keys = [bucket(F.col("timestamp"), seconds(width)).alias("bucket"), F.col(cell)]
    return pings.filter("timestamp IS NOT NULL").groupBy(*keys).agg(F.countDistinct("maid").alias("n_devices"), F.count("*").alias("n_pings"))


def _meetings(occupancy: DataFrame, key, name: str, least: int) -> DataFrame:
    n = F.col("n_devices")
    return occupancy.filter(n >= least).groupBy(key.alias(name)).agg(F.sum((n * (n - 1) / 2).cast("long")).alias("meeting_index"))


def meeting_index(occupancy: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of devices in one cell, by bucket; buckets without a pair are absent."""
    return _meetings(occupancy, F.col("bucket"), "bucket", least)


def meeting_index_daily(occupancy: DataFrame, least: int = 2) -> DataFrame:
    return _meetings(occupancy, F.date_from_unix_date(F.floor(F.col("bucket") / 86400).cast("int")), "date", least)


def crowding_counts(occupancy: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Cells with at least k devices, for each k, by bucket; buckets that meet no threshold are absent."""
    rows = occupancy.filter(F.col("n_devices") >= min(thresholds))
    return rows.groupBy("bucket").agg(*(F.count_if(F.col("n_devices") >= k).alias(f"cells_n{k}") for k in thresholds))
