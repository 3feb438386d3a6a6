"""Overviews and the questions of the notebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.operators.quantiles import exact_quantiles


def overview_mobility(pings: DataFrame) -> DataFrame:
    return pings.agg(
        F.count("*").alias("n_pings"), F.countDistinct("maid").alias("n_devices"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min("latitude").alias("south"), F.max("latitude").alias("north"),
    )


def device_overlap(pings: DataFrame, people: DataFrame) -> DataFrame:
    """Devices with pings, with a profile, with both, and the share of the first. One pass over flags, no set operation on rows."""
    flags = pings.select("maid", F.lit(1).alias("a"), F.lit(0).alias("b")).union(people.select("maid", F.lit(0), F.lit(1)))
    per = flags.groupBy("maid").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = per.agg(F.sum("a").alias("n_mobility"), F.sum("b").alias("n_people"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
    return out.withColumn("share", F.col("n_both") / F.nullif(F.col("n_mobility"), F.lit(0)))


def value_counts(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n for all columns at once: one scan."""
    kinds = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))
    rows = profiles.select(F.explode(kinds).alias("k")).select("k.*").filter("value IS NOT NULL")
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def crosstab(profiles: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    known = profiles.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return known.groupBy(rows).agg(*(F.count_if(F.col(columns) == v).alias(v) for v in values))


def with_profiles(pings: DataFrame, profiles: DataFrame) -> DataFrame:
    return pings.join(profiles, "maid", "left")


def match_rates(pings: DataFrame, profiles: DataFrame, columns: list[str]) -> DataFrame:
    rows = with_profiles(pings.select("maid"), profiles.select("maid", *columns))
    return rows.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_rate") for c in columns))


def pivot_normalised(pings: DataFrame, profiles: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Daily pings by class over the class's mean of its days."""
    rows = with_profiles(pings.select("maid", "date"), profiles.select("maid", column)).filter(F.col(column).isNotNull())
    daily = rows.groupBy("date").agg(*(F.nullif(F.count_if(F.col(column) == v), F.lit(0)).alias(v) for v in values))
    return daily.select("date", *((F.col(v) / F.avg(v).over(W.partitionBy())).alias(v) for v in values))  # one row a day


def two_level_mean(pings: DataFrame, profiles: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Mean pings of a device and day, by two profile columns."""
    joined = with_profiles(pings.select("maid", "date"), profiles.select("maid", rows, columns)).filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    per = joined.groupBy(rows, columns, "maid", "date").agg(F.count("*").alias("n"))
    return per.groupBy(rows).agg(*(F.avg(F.when(F.col(columns) == v, F.col("n"))).alias(v) for v in values))


def share_comparison(pings: DataFrame, profiles: DataFrame, column: str) -> DataFrame:
    """Each value's share of profiles and of pings, in percent, and their ratio."""
    share = lambda df, name: df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).select(column, (F.col("n") / F.sum("n").over(W.partitionBy()) * 100).alias(name))
    both = share(profiles, "profile_share").join(share(with_profiles(pings.select("maid"), profiles.select("maid", column)), "ping_share"), column, "full_outer")
    both = both.select(column, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("profile_share", "ping_share")))
    return both.withColumn("ratio", F.col("ping_share") / F.nullif(F.col("profile_share"), F.lit(0.0)))


def place_rollup(pings: DataFrame, profiles: DataFrame, levels: list[str]) -> DataFrame:
    """Devices and pings at every level of a hierarchy of places, from `levels` in full down to the total.

    level is the grouping id: bit k is set where the k-th place from the right is summed over, so a missing place (level 0, null) and a
    sum over places differ. Pings are counted by device first: devices are then plain counts at all levels, and no set is carried.
    """
    per = pings.filter("maid IS NOT NULL").groupBy("maid").agg(F.count("*").alias("n"))
    rows = per.join(profiles.select("maid", *levels), "maid", "left")
    return rows.rollup(*levels).agg(F.grouping_id().alias("level"), F.count("*").alias("n_devices"), F.sum("n").alias("n_pings"))


def clipped_histogram(values: DataFrame, column: str, most: float, bins: int = 40) -> DataFrame:
    """bin 0..bins-1 of equal width up to `most`; greater values are in the last."""
    at = F.least(F.floor(F.least(F.col(column), F.lit(float(most))) * bins / most), F.lit(bins - 1)).cast("long")
    return values.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def hexbin(pings: DataFrame, index) -> DataFrame:
    cell = index.cell(F.col("longitude"), F.col("latitude"))
    return pings.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).withColumn("log10_n", F.log10(F.col("n").cast("double")))


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "seq") -> DataFrame:
    """n random rows (all, if there are fewer): those whose key has the least hash with the seed, so they do not depend on the files."""
    chance = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_r", chance).orderBy("_r", key).limit(n).drop("_r")


def run_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and exact median of each column. The rows are kept while they are read several times, in memory or on disk."""
    rows = metrics.select(*columns).persist()
    try:
        means = rows.agg(*(F.avg(c) for c in columns)).first()
        medians = exact_quantiles(rows, columns)
    finally:
        rows.unpersist()
    values = [x for c, mean in zip(columns, means, strict=True) for x in (mean, medians[c][0])]
    names = [f"{n}_{c}" for c in columns for n in ("mean", "median")]
    return metrics.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(n) for v, n in zip(values, names, strict=True)))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, share, value: exact quantiles of several columns, with a few passes and bounded tasks."""
    rows = df.select(*columns).persist()
    try:
        found = exact_quantiles(rows, columns, shares)
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(c, float(s), v) for c in columns for s, v in zip(shares, found[c], strict=True)], "column string, share double, value double")
