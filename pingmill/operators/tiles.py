"""Scans along each device's pings in two levels, so that a device with most of the rows is still spread over all tasks.

Pings are dealt by device and time tile. Inside a tile a window gives each ping its predecessor and running counts; one row a tile
(its first and last ping and its counts) then goes through a window over the device's tiles, and what it carries over from earlier
tiles comes back by an equal join, for which the pings do not move again. A task holds one device's pings of one tile; the second
level has a row for every tile with pings, some thousands for a device of many years.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a tile.
WIDTH = 21_600
#: Stands for a missing device or time in keys, which must be equal to meet in a join.
NO_NAME, NO_TILE = "\x00", -(1 << 60)


def number(seconds: Column, width: int) -> Column:
    return F.coalesce(F.floor(seconds / F.lit(width)).cast("long"), F.lit(NO_TILE))


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(NO_NAME)) for k in keys if kinds[k] == "string"})


def _unnamed(df: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.nullif(F.col(k), F.lit(NO_NAME)) for k in keys if kinds[k] == "string"})


def joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the carried columns of their tile."""
    return rows.join(carried, [*keys, "_tile"], "left")


def scan(rows: DataFrame, fields: list[str], keys=("maid",), order=("timestamp", "seq"), width: int = WIDTH, flag: Callable[[Column, Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """rows with _tile, _prev (struct of `fields` of the device's previous row, null at its first), _n (rows of the device before this
    one) and, with `flag`, _flag and _flags (flagged rows of the device up to this one).

    order: its first column is Unix seconds, by which tiles are cut; rows without a time come first. flag(previous, now): a condition
    on the previous row's struct and on this row's columns; it counts as false where it is null.
    """
    keys, order = list(keys), list(order)
    rows = _named(rows, keys).withColumn("_tile", number(F.col(order[0]), width))
    inner = W.partitionBy(*keys, "_tile").orderBy(*order)
    here = F.struct(*fields)
    rows = rows.withColumns({"_prev": F.lag(here).over(inner), "_n": F.row_number().over(inner) - 1})
    rows = rows.withColumn("_flag", F.coalesce(flag(F.col("_prev"), F.col), F.lit(False)) if flag else F.lit(False))
    if flag:
        rows = rows.withColumn("_flags", F.sum(F.col("_flag").cast("long")).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "_tile").agg(F.min_by(here, at).alias("_a"), F.max_by(here, at).alias("_z"), F.count("*").alias("_k"), F.sum(F.col("_flag").cast("long")).alias("_f"))
    outer = W.partitionBy(*keys).orderBy("_tile")
    before = outer.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.lag("_z").over(outer))
    ends = ends.withColumn("_edge", F.coalesce(flag(F.col("_carry"), lambda c: F.col("_a")[c]), F.lit(False)) if flag else F.lit(False))
    sums = {"_k": F.coalesce(F.sum("_k").over(before), F.lit(0)), "_f": F.coalesce(F.sum(F.col("_f") + F.col("_edge").cast("long")).over(before), F.lit(0))}
    rows = joined(rows, ends.withColumns(sums).drop("_a", "_z"), keys)
    first = F.col("_prev").isNull() & F.col("_carry").isNotNull()
    rows = rows.withColumns({"_prev": F.coalesce("_prev", "_carry"), "_n": F.col("_n") + F.col("_k"), "_flag": F.col("_flag") | (first & F.col("_edge"))})
    if flag:
        rows = rows.withColumn("_flags", F.col("_flags") + F.col("_f") + F.col("_edge").cast("long"))
    return _unnamed(rows.drop("_carry", "_edge", "_k", "_f", *([] if flag else ["_flag"])), keys)


def last_at_or_before(have: DataFrame, ask: DataFrame, value: str, by: str, key: str = "maid", width: int = 3600) -> DataFrame:
    """ask(key, by, ...) with `value` of the have(key, by, value) row with the greatest `by` not above its own; null where there is none.

    have has one row a (key, by).
    """
    extra = [c for c in ask.columns if c not in (key, by)]
    packed = F.struct(*extra) if extra else F.lit(True)
    rows = have.select(key, by, value, F.lit(0).alias("_ask")).unionByName(ask.select(key, by, packed.alias("_x"), F.lit(1).alias("_ask")), allowMissingColumns=True)
    rows = _named(rows, [key]).withColumn("_tile", number(F.col(by), width))
    inner = W.partitionBy(key, "_tile").orderBy(by, "_ask").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inner))
    ends = rows.groupBy(key, "_tile").agg(F.max_by(value, F.when(F.col("_ask") == 0, F.col(by))).alias("_z"))
    before = W.partitionBy(key).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(key, "_tile", F.last("_z", ignorenulls=True).over(before).alias("_carry"))
    found = joined(rows.filter("_ask = 1").drop(value), carried, [key]).withColumn(value, F.coalesce("_in", "_carry"))
    return _unnamed(found.select(key, by, *(F.col(f"_x.{c}").alias(c) for c in extra), value), [key])
