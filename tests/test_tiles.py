"""Two-level scans against plain windows, and how a device with nearly all rows is dealt."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.operators import clean, tiles, traces


def some(ping, n=600, seed=3):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.9 else rnd.choice("abc"), rnd.randrange(200_000), rnd.random(), rnd.random(), rnd.randrange(50)) for _ in range(n)]
    rows += [("hot", 43_200, 0.5, 0.5, k) for k in range(5)] + [(None, t, 0.1, 0.1, t) for t in (5, 50_000, 50_001)]
    return ping(rows).drop("cell")


def test_scan_is_a_window(ping):
    rows = some(ping)
    w = W.partitionBy("maid").orderBy("timestamp", "seq", "longitude")
    flag = F.col("timestamp") - F.lag("timestamp").over(w) > 600
    plain = rows.select("*", F.lag("longitude").over(w).alias("p"), (F.row_number().over(w) - 1).alias("n"), F.coalesce(flag, F.lit(False)).alias("flag"))
    plain = plain.withColumn("flags", F.sum(F.col("flag").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    for width in (100, 5_000, 21_600, 10**9):
        got = tiles.scan(rows, ["longitude", "timestamp"], order=("timestamp", "seq", "longitude"), width=width, flag=lambda p, c: c("timestamp") - p["timestamp"] > 600)
        got = got.select(*rows.columns, F.col("_prev.longitude").alias("p"), F.col("_n").alias("n"), F.col("_flag").alias("flag"), F.col("_flags").alias("flags"))
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_rows_without_a_time_come_first(spark):
    rows = spark.createDataFrame([("a", None, 1, 0.0), ("a", None, 2, 1.0), ("a", 5, 0, 2.0), ("a", 99_999, 3, 3.0)], "maid string, timestamp long, seq long, v double")
    got = tiles.scan(rows, ["v"], flag=lambda p, c: c("timestamp") - p["timestamp"] > 1 if False else F.lit(True)).orderBy("v").collect()
    assert [(r._n, r._prev and r._prev.v) for r in got] == [(0, None), (1, 0.0), (2, 1.0), (3, 2.0)]


@pytest.mark.parametrize("tile", [60, 21_600, 10**9])
def test_tiles_do_not_show(ping, tile):
    rows = some(ping)
    whole = 10**12
    text = lambda df: sorted(map(str, df.collect()))
    assert text(traces.line_segments(rows, tile=tile)) == text(traces.line_segments(rows, tile=whole))
    assert text(traces.points(rows, tile=tile)) == text(traces.points(rows, tile=whole))
    assert text(clean.speed_outliers(rows, tile=tile)) == text(clean.speed_outliers(rows, tile=whole))
    lines = traces.line_segments(rows, tile=tile).filter("kind = 'move'").agg(F.sum("n")).first()[0]
    alone = traces.segment_parts(rows, tile=tile).groupBy("maid", "segment").agg(F.sum("n").alias("n")).filter("n = 1").count()
    assert lines + alone == rows.count()


@pytest.mark.parametrize("width", [7, 3600, 10**9])
def test_last_at_or_before(spark, width):
    rnd = random.Random(width)
    have = {(m, rnd.randrange(20_000)): rnd.random() for m in ("a", "b", None) for _ in range(60)}
    ask = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(22_000), k) for k in range(300)] + [("a", 5, 1), ("a", 5, 1)]
    h = spark.createDataFrame([(*k, v) for k, v in have.items()], "maid string, t long, v double")
    got = tiles.last_at_or_before(h, spark.createDataFrame(ask, "maid string, t long, k long"), "v", "t", width=width).collect()

    def plain(m, t):
        mine = [(x, v) for (n, x), v in have.items() if n == m and x <= t]
        return max(mine)[1] if mine else None

    assert sorted(map(str, map(tuple, got))) == sorted(str((m, t, k, plain(m, t))) for m, t, k in ask)


def test_a_hot_device_is_spread(spark, ping):
    """One device has 90 % of the rows; no task holds more than a small part of them."""
    conf = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(c) for c in conf]
    spark.conf.set(conf[0], "false")
    spark.conf.set(conf[1], "16")
    try:
        t = F.col("id") * 60
        rows = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("d"), F.col("id") % 50)).otherwise("hot").alias("maid"), t.alias("timestamp"), F.col("id").alias("seq"), (F.col("id") % 100 / 100).alias("longitude"), F.lit(0.0).alias("latitude"))
        for df, used in ((clean.speed_outliers(rows), "is_outlier"), (traces.points(rows), "speed_kmh")):
            n = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(used)).collect()]
            assert len(n) == 16 and sum(n) == 60_000 and max(n) < 3 * 60_000 / 16
        parts = traces.segment_parts(rows)
        assert parts.agg(F.max("n")).first()[0] <= 360 and traces.line_segments(rows).filter("maid = 'hot'").count() == 1
        have = traces.points(rows)
        n = [r["n"] for r in traces.as_of_join(have, rows.select("maid", F.pmod("timestamp", F.lit(86_400)).alias("tsec"))).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("idx")).collect()]
        assert sum(n) == 60_000 and max(n) < 5 * 60_000 / 16
    finally:
        for c, v in zip(conf, old, strict=True):
            spark.conf.set(c, v)
