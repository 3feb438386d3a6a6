"""Density of cells and how concentrated it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.functions import geo

def aggregate_grid(pings: DataFrame, by_date: bool = False, cell: str = "cell") -> DataFrame:
    keys = ["date", cell] if by_date else [cell]
    return pings.filter("date IS NOT NULL" if by_date else "true").groupBy(*keys).agg(F.count("*").alias("count"))


def concentration(grid: DataFrame, value: str = "count", keys: tuple[str, ...] = (), measures=("hhi", "gini")) -> DataFrame:
    """Sum of squared shares and Gini coefficient of a value, by group or overall.

    Gini over ascending values x_1..x_n is 2 sum(i x_i) / (n sum x) - (n + 1) / n; equal values share their rows' ranks without
    changing the sum, so values are counted first and the ranks of a whole run are summed at once: the ordered window sees one
    row for each distinct value, not for each cell.
    """
    runs = grid.groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("k"))
    w = W.partitionBy(*keys).orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("k").over(w), F.lit(0))
    runs = runs.withColumn("ranked", F.col("x") * (F.col("k") * before + F.col("k") * (F.col("k") + 1) / 2))
    sums = runs.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("x") * F.col("k")).alias("t"), F.sum(F.col("x") * F.col("x") * F.col("k")).alias("s"), F.sum("ranked").alias("r"))
    total = F.when(F.col("t") > 0, F.col("t"))
    made = {"hhi": F.col("s") / (total * total), "gini": 2 * F.col("r") / (F.col("n") * total) - (F.col("n") + 1) / F.col("n")}
    return sums.select(*keys, *(made[m].alias(m) for m in measures))


def top_cells(grid: DataFrame, k: int = 50_000, cell: str = "cell") -> DataFrame:
    return grid.orderBy(F.col("count").desc(), cell).limit(k)


def area_visits(pings: DataFrame, areas: DataFrame, name: str = "name") -> DataFrame:
    """name, n_pings, n_devices of the areas(name, ring[, holes]) that hold pings; '' for the pings in no area.

    Pings are counted by place and device before they meet areas, and names with equal outlines are looked up as one, so what is
    expanded are the places of each device by the different outlines around them. A ping counts once for each outline of a name.
    """
    outline = F.struct("ring", *(c for c in ("holes",) if c in areas.columns))
    rows = areas.filter(F.size("ring") > 0).select(F.coalesce(name, F.lit("")).alias("name"), outline.alias("outline"))
    rows = rows.groupBy("name").agg(F.sort_array(F.collect_list("outline")).alias("outlines"))  # the parts of one area
    rows = rows.withColumn("_key", F.sha2(F.to_json(F.struct("outlines")), 256))
    # '' stays alone, as it also is where pings in no area go.
    shapes = rows.filter("name <> ''").groupBy("_key").agg(F.min("name").alias("_shape"))
    names = rows.filter("name <> ''").join(shapes, "_key").select("_shape", "name")
    least = rows.join(shapes, rows["name"] == shapes["_shape"], "left").filter("name = '' OR _shape IS NOT NULL")
    least = least.select(F.col("name").alias("_shape"), F.inline("outlines"))
    places = pings.groupBy("longitude", "latitude", "maid").agg(F.count("*").alias("n"))
    visits = geo.within(places, least, "_shape").groupBy("_shape", "maid").agg(F.sum("n").alias("n"))
    visits = visits.groupBy("_shape").agg(F.sum("n").alias("n_pings"), F.count("maid").alias("n_devices"))
    return visits.join(names, "_shape", "left").select(F.coalesce("name", F.lit("")).alias(name), "n_pings", "n_devices")
