"""Home cells: the cell with the most pings at night."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.functions.cells import DEFAULT

NIGHT = (22, 5)


def at_night(pings: DataFrame, hours: tuple[int, int] | None = NIGHT, tz_offset_hours: int = 0) -> DataFrame:
    """Pings whose hour lies in the window, both ends included; it may pass midnight. None: all hours."""
    if hours is None:
        return pings
    h = F.pmod(F.col("hour") + tz_offset_hours, F.lit(24))
    a, b = hours
    return pings.filter(h.between(a, b) if a <= b else (h >= a) | (h <= b))


def night_counts(pings: DataFrame, hours=NIGHT, cell: str = "cell") -> DataFrame:
    return at_night(pings, hours).groupBy("maid", cell).agg(F.count("*").alias("n"))


def night_parts(pings: DataFrame, hours=NIGHT, cell: str = "cell", tz_offset_hours: int = 0) -> DataFrame:
    """maid, cell, date, n: night pings of a device, cell and date. Parts of different dates merge by union, so they can be stored."""
    return at_night(pings, hours, tz_offset_hours).groupBy("maid", cell, "date").agg(F.count("*").alias("n"))


def detect_homes(pings: DataFrame, hours=NIGHT, min_nights: int = 1, index=DEFAULT, cell: str = "cell", tz_offset_hours: int = 0) -> DataFrame:
    """maid, home_cell, n_home_pings, n_nights (distinct dates with any night ping), home_lat, home_lon; ties go to the first name.

    Pings are counted by (maid, cell, date) before anything moves; one exchange on maid of those counts serves the rest.
    """
    return homes_of(night_parts(pings, hours, cell, tz_offset_hours), min_nights, index, cell)


def homes_of(per_day: DataFrame, min_nights: int = 1, index=DEFAULT, cell: str = "cell", dealt: bool = False) -> DataFrame:
    """The homes that `night_parts` of any dates give. dealt: the rows lie by maid already, as those of a bucketed table do."""
    # A date counts in the row of its first cell only, so that nights are a sum and no list of dates is carried.
    first = F.row_number().over(W.partitionBy("maid", "date").orderBy(cell)) == 1
    per_day = (per_day if dealt else per_day.repartition("maid")).withColumn("_night", F.when(first & F.col("date").isNotNull(), 1).otherwise(0))
    per = per_day.groupBy("maid", cell).agg(F.sum("n").alias("n"), F.sum("_night").alias("nights"))
    w = W.partitionBy("maid").orderBy(F.col("n").desc(), cell)
    top = per.withColumns({"_r": F.row_number().over(w), "n_nights": F.sum("nights").over(W.partitionBy("maid"))}).filter("_r = 1")
    lon, lat = index.centre(F.col(cell))
    out = top.select("maid", F.col(cell).alias("home_cell"), F.col("n").alias("n_home_pings"), F.col("n_nights").cast("long").alias("n_nights"), lat.alias("home_lat"), lon.alias("home_lon"))
    return out.filter(F.col("n_nights") >= min_nights)
