"""Cleaning of pings and profiles. Missing values are null throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.functions.geo import haversine_km
from pingmill.operators import tiles

MISSING = "\\N"


def clean_mobility(df: DataFrame) -> DataFrame:
    """Drops repeated header rows and rows without a place; adds datetime, date and hour (UTC, whatever the session's zone).

    A timestamp that cannot be read stays as a row with null time columns.
    """
    df = df.filter(F.col("timestamp").isNull() | (F.col("timestamp").cast("string") != "timestamp"))
    df = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    df = df.withColumn("timestamp", F.col("timestamp").try_cast("long"))
    at = F.expr("timestampadd(SECOND, timestamp, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return df.withColumn("datetime", at).withColumns({"date": F.to_date("datetime"), "hour": F.hour("datetime")})


def speed_outliers(pings: DataFrame, max_kph: float = 120.0, min_gap_min: float = 0.1, out: str = "is_outlier", order=("timestamp", "seq"), tile: int = tiles.WIDTH) -> DataFrame:
    """pings with a flag: faster than max_kph from the previous raw ping, at least min_gap_min later. First pings and gaps of 0 never are.

    order: begins with the time; a device's pings are scanned in tiles of `tile` seconds, so one with most of the rows is spread.
    """
    rows = tiles.scan(pings, ["longitude", "latitude", "timestamp"], order=order, width=tile)
    km = haversine_km(F.col("_prev.longitude"), F.col("_prev.latitude"), F.col("longitude"), F.col("latitude"))
    minutes = (F.col("timestamp") - F.col("_prev.timestamp")) / 60.0
    fast = km / F.nullif(minutes / 60.0, F.lit(0.0)) > max_kph
    return rows.withColumn(out, F.coalesce((minutes > 0) & (minutes >= min_gap_min) & fast, F.lit(False))).select(*(c for c in pings.columns if c != out), out)


def filter_speed_outliers(pings: DataFrame, max_kph: float = 120.0, min_gap_min: float = 0.1) -> DataFrame:
    return speed_outliers(pings, max_kph, min_gap_min, "_outlier").filter(~F.col("_outlier")).drop("_outlier")


def clean_people(people: DataFrame) -> DataFrame:
    """The literal for missing values becomes null in every string column."""
    return people.select(*(F.nullif(F.col(c), F.lit(MISSING)).alias(c) if t == "string" else F.col(c) for c, t in people.dtypes))


def profiles(people: DataFrame, order: str = "profile_no") -> DataFrame:
    """The first row of each device."""
    n = F.row_number().over(W.partitionBy("maid").orderBy(order))
    return people.withColumn("_n", n).filter("_n = 1").drop("_n")
