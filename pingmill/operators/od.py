"""Origin-destination flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.functions.cells import DEFAULT
from pingmill.functions.geo import haversine_km


#: Rows of a table that is broadcast without measuring it.
MOST_BROADCAST = 10_000


def first_dates(df: DataFrame, days: int | Sequence[str]) -> DataFrame:
    """The first so many distinct dates, or the given ones: a few rows."""
    if isinstance(days, int):
        return df.select("date").filter("date IS NOT NULL").distinct().orderBy("date").limit(days)
    return df.sparkSession.createDataFrame([(d,) for d in days], "date string").select(F.col("date").cast("date"))


def with_baseline_flag(df: DataFrame, days: int | Sequence[str]) -> DataFrame:
    flag = first_dates(df, days).withColumn("is_baseline", F.lit(True))
    if (days if isinstance(days, int) else len(days)) <= MOST_BROADCAST:
        flag = F.broadcast(flag)
    return df.join(flag, "date", "left").withColumn("is_baseline", F.coalesce("is_baseline", F.lit(False)))


def change(value: Column, base: Column) -> Column:
    """Percent change; null where the base is 0 or null."""
    return (value - base) / F.nullif(base, F.lit(0.0)) * 100


def device_day_od(pings: DataFrame, cell: str = "cell") -> DataFrame:
    """First and last cell of each device and day, and its pings; equal times go by seq."""
    at = F.struct("timestamp", "seq")
    return pings.filter("date IS NOT NULL").groupBy("maid", "date").agg(F.min_by(cell, at).alias("origin"), F.max_by(cell, at).alias("dest"), F.count("*").alias("n_pings"))


def aggregate_od(od: DataFrame, directed: bool = True) -> DataFrame:
    if not directed:
        od = od.withColumns({"origin": F.least("origin", "dest"), "dest": F.greatest("origin", "dest")})
    return od.groupBy("date", "origin", "dest").agg(F.countDistinct("maid").alias("n_devices"), F.sum("n_pings").alias("n_pings"))


def flow_distance(flows: DataFrame, index=DEFAULT) -> DataFrame:
    """Distance of the cells' centres, from the names alone: no join."""
    (a, b), (c, d) = index.centre(F.col("origin")), index.centre(F.col("dest"))
    return flows.withColumn("od_distance_km", haversine_km(a, b, c, d))


def corridor_change(flows: DataFrame, baseline_days: int | Sequence[str], value: str = "n_pings", min_flow: float | None = None) -> DataFrame:
    """Each flow against its pair's mean over the baseline days on which the pair was seen."""
    flagged = with_baseline_flag(flows, baseline_days)
    base = flagged.filter("is_baseline").groupBy("origin", "dest").agg(F.avg(value).alias(f"{value}_baseline"))
    out = flagged.join(base, ["origin", "dest"], "left")
    if min_flow is not None:
        out = out.filter(F.col(f"{value}_baseline") >= min_flow)
    return out.withColumn(f"{value}_pct_change", change(F.col(value), F.col(f"{value}_baseline")))


def cell_district_map(homes: DataFrame, people: DataFrame, level: str = "place1", order: str = "profile_no") -> DataFrame:
    """home_cell -> the commonest non-null level among the devices homed there (ties: the first by name).

    A device counts with its first profile row that has the level.
    """
    named = people.filter(F.col(level).isNotNull()).groupBy("maid").agg(F.min_by(level, order).alias("label"))
    counts = homes.join(named, "maid").groupBy("home_cell", "label").agg(F.count("*").alias("n"))
    top = F.row_number().over(W.partitionBy("home_cell").orderBy(F.col("n").desc(), "label"))
    return counts.withColumn("_n", top).filter("_n = 1").select("home_cell", "label")


def label_flows(flows: DataFrame, cell_map: DataFrame, missing: str = "unknown") -> DataFrame:
    """Both ends' labels. The map has one row a cell; Spark broadcasts it by its measured size, or joins by key."""
    for end in ("origin", "dest"):
        flows = flows.join(cell_map.select(F.col("home_cell").alias(end), F.col("label").alias(f"{end}_place")), end, "left")
        flows = flows.withColumn(f"{end}_place", F.coalesce(f"{end}_place", F.lit(missing)))
    return flows


def aggregate_od_by_place(flows: DataFrame) -> DataFrame:
    return flows.groupBy("date", "origin_place", "dest_place").agg(F.sum("n_devices").alias("n_devices"), F.sum("n_pings").alias("n_pings"))


def net_flows(flows: DataFrame, origin: str = "origin_place", dest: str = "dest_place", value: str = "n_pings", include_reverse_only: bool = False) -> DataFrame:
    """f(a->b) - f(b->a) for a < b. Pairs seen only as b->a are left out unless asked for. One aggregate instead of a self join."""
    forward = F.col(origin) < F.col(dest)
    rows = flows.filter(F.col(origin) != F.col(dest)).groupBy("date", F.least(origin, dest).alias("pair_a"), F.greatest(origin, dest).alias("pair_b"))
    out = rows.agg(F.sum(F.when(forward, F.col(value)).otherwise(-F.col(value))).alias(f"net_{value}"), F.max(forward).alias("_seen"))
    return (out if include_reverse_only else out.filter("_seen")).drop("_seen")


def between_places(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("origin") != F.col("dest"))


def top_corridors(flows: DataFrame, k: int = 10) -> DataFrame:
    """The daily series of the k pairs with the most pings."""
    top = flows.groupBy("origin", "dest").agg(F.sum("n_pings").alias("_t")).orderBy(F.col("_t").desc(), "origin", "dest").limit(k)
    pairs = top.select("origin", "dest")
    return flows.join(F.broadcast(pairs) if k <= MOST_BROADCAST else pairs, ["origin", "dest"], "left_semi")
