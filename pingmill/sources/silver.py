"""The silver table: clean pings with cells, stored by date and bucketed by device.

Queries that work device by device (homes, movement of a device and day, flows) read it bucket by bucket and so need no exchange by
device: neither for their windows and aggregates nor for joining pings with homes. It is written once with one exchange; filters on
date reach its folders. It is a table of the session's catalog, since Spark keeps the buckets' layout there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pingmill.functions.cells import with_cells
from pingmill.operators import homes, metrics, od
from pingmill.plans.pipeline import Config

#: A bucket is one task of every query by device: choose it so that a bucket of all dates fits a task.
BUCKETS = 64


def save(pings: DataFrame, table: str, config: Config = Config(), buckets: int = BUCKETS) -> None:
    """Writes pings (without cells) as the silver table. One file a date and bucket."""
    rows = with_cells(pings, config.index).repartition(buckets, "maid")
    rows.write.mode("overwrite").format("parquet").option("compression", "zstd").partitionBy("date").bucketBy(buckets, "maid").sortBy("maid", "timestamp", "seq").saveAsTable(table)


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def detect_homes(pings: DataFrame, config: Config = Config()) -> DataFrame:
    """As `homes.detect_homes`, of the silver table's rows, without an exchange."""
    return homes.homes_of(homes.night_parts(pings, config.night), config.min_nights, config.index, dealt=True)


def products(pings: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Homes, movement of each device and day, and flows of the silver table's rows: what needs pings device by device."""
    found = detect_homes(pings, config)
    trips = od.device_day_od(pings)
    return {"homes": found, "metrics_device_day": metrics.device_day_metrics(pings, found), "od_device_day": trips, "od_flows": od.aggregate_od(trips)}
