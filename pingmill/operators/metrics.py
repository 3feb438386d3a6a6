"""Movement of each device and day, daily summaries, and indexes against a baseline."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.functions.geo import haversine_km
from pingmill.operators.od import change

SUMMARY = ("n_devices", "n_device_days", "n_pings", "n_trips", "radius_km", "n_cells", "max_dist_home_km", "stay_at_home", "pings_per_device_day")


def device_day_metrics(pings: DataFrame, homes: DataFrame | None = None, cell: str = "cell") -> DataFrame:
    """One row a device and day. The first ping counts as a trip; a device without a home has stay_at_home false and no distance.

    The windows and the aggregate share one exchange: on (maid, date), so that a busy device's days are dealt over tasks, or on maid
    where the join with homes has made that one already.
    """
    rows = pings.filter("date IS NOT NULL")
    if homes is not None:
        rows = rows.join(homes.select("maid", "home_cell", "home_lat", "home_lon"), "maid", "left")
    day = W.partitionBy("maid", "date")
    before = F.lag(cell).over(day.orderBy("timestamp", "seq"))
    rows = rows.withColumns({"_b": before, "_x": F.avg("longitude").over(day), "_y": F.avg("latitude").over(day)})
    off = haversine_km(F.col("longitude"), F.col("latitude"), F.col("_x"), F.col("_y"))
    rows = rows.withColumn("_off", off * off)
    aggs = [
        F.count("*").alias("n_pings"),
        F.countDistinct(cell).alias("n_cells"),
        F.sum(F.when(F.col("_b").isNull() | (F.col("_b") != F.col(cell)), 1).otherwise(0)).alias("n_trips"),
        F.sqrt(F.avg("_off")).alias("radius_km"),
    ]
    if homes is None:
        aggs += [F.lit(None).cast("double").alias("max_dist_home_km"), F.lit(None).cast("boolean").alias("stay_at_home")]
    else:
        away = haversine_km(F.col("longitude"), F.col("latitude"), F.col("home_lon"), F.col("home_lat"))
        aggs += [F.max(away).alias("max_dist_home_km"), F.bool_and(F.coalesce(F.col(cell) == F.col("home_cell"), F.lit(False))).alias("stay_at_home")]
    return rows.groupBy("maid", "date").agg(*aggs)


def daily_summary(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    for k in keys:
        metrics = metrics.filter(F.col(k).isNotNull())
    out = metrics.groupBy("date", *keys).agg(
        F.countDistinct("maid").alias("n_devices"),
        F.count("*").alias("n_device_days"),
        F.sum("n_pings").alias("n_pings"),
        F.sum("n_trips").alias("n_trips"),
        F.avg("radius_km").alias("radius_km"),
        F.avg("n_cells").alias("n_cells"),
        F.avg("max_dist_home_km").alias("max_dist_home_km"),
        F.avg(F.col("stay_at_home").cast("double")).alias("stay_at_home"),
    )
    return out.withColumn("pings_per_device_day", F.col("n_pings") / F.col("n_device_days"))


def mobility_index(daily: DataFrame, baseline_days: int | Sequence[str], values: Sequence[str] = SUMMARY, keys: Sequence[str] = ()) -> DataFrame:
    """Each value's baseline mean (overall or by group) and percent change. Baseline days are the first of the whole input.

    daily has one row a date (and group), which is all that the windows see; nothing is computed twice.
    """
    if isinstance(baseline_days, int):
        chosen = F.col("date").isNotNull() & (F.dense_rank().over(W.orderBy(F.col("date").asc_nulls_last())) <= baseline_days)
    else:
        chosen = F.coalesce(F.col("date").isin([date.fromisoformat(str(d)) for d in baseline_days]), F.lit(False))
    out = daily.withColumn("is_baseline", chosen)
    means = {f"{c}_baseline": F.avg(F.when(F.col("is_baseline"), F.col(c))).over(W.partitionBy(*keys)) for c in values}
    return out.withColumns(means).withColumns({f"{c}_pct_change": change(F.col(c), F.col(f"{c}_baseline")) for c in values})


__all__ = ["SUMMARY", "daily_summary", "device_day_metrics", "mobility_index"]
