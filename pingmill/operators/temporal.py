"""Counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3600


def bucket(seconds, width: int):
    """Start of the bucket of `width` seconds that holds a Unix time."""
    return seconds - F.pmod(seconds, F.lit(width))


def daily_counts(pings: DataFrame) -> DataFrame:
    return pings.filter("date IS NOT NULL").groupBy("date").agg(F.count("*").alias("n_pings"), F.countDistinct("maid").alias("n_devices"))


def hourly_counts(pings: DataFrame) -> DataFrame:
    """Pings by hour; hours without any are absent."""
    return pings.filter("timestamp IS NOT NULL").groupBy(bucket(F.col("timestamp"), HOUR).alias("bucket")).agg(F.count("*").alias("n_pings"))


def hourly_zero_filled(pings: DataFrame) -> DataFrame:
    """Pings by hour from the first to the last; hours without any have 0."""
    hours = hourly_counts(pings)
    ends = hours.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every = ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.lit(HOUR).cast("long"))).alias("bucket"))
    return every.join(hours, "bucket", "left").select("bucket", F.coalesce("n_pings", F.lit(0)).alias("n_pings"))


def diurnal_profile(pings: DataFrame) -> DataFrame:
    """By hour of day: pings, days in which that hour occurs, and their ratio."""
    rows = pings.filter("hour IS NOT NULL").groupBy("hour").agg(F.count("*").alias("n_pings"), F.countDistinct("date").alias("n_days"))
    return rows.withColumn("mean_pings", F.col("n_pings") / F.col("n_days"))


def diurnal_overall(pings: DataFrame) -> DataFrame:
    """By hour of day: pings over the number of all distinct days."""
    days = pings.agg(F.countDistinct("date").alias("n_days"))
    rows = pings.filter("hour IS NOT NULL").groupBy("hour").agg(F.count("*").alias("n_pings"))
    return rows.crossJoin(F.broadcast(days)).withColumn("mean_pings", F.col("n_pings") / F.col("n_days"))
