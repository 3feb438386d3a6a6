"""Stateful streams against their batch forms: order, late pings, pings without a time."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pingmill.operators import clean, traces
from pingmill.sources import views
from pingmill.streaming import live

D = "/root/testdata/sf0.001"
SCHEMA = "maid string, seq long, timestamp long, longitude double, latitude double, at timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def stream_of(spark, tmp_path, batches):
    """A stream that reads the DataFrames one by one."""
    at = time.time()
    for k, df in enumerate(batches):
        folder = f"{tmp_path}/in/{k}"
        df.select("maid", "seq", "timestamp", "longitude", "latitude", F.timestamp_seconds("timestamp").alias("at")).coalesce(1).write.parquet(folder)
        for name in os.listdir(folder):
            os.utime(os.path.join(folder, name), (at + 60 * k, at + 60 * k))
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start().awaitTermination(240)
    return df.sparkSession.table(name)


def rows_of(spark, rows):
    return spark.createDataFrame([(m, q, t, float(x), float(y)) for q, (m, t, x, y) in enumerate(rows)], "maid string, seq long, timestamp long, longitude double, latitude double")


LATER = [("later", 10**9, 0, 0)]


def test_gap_lines_equal_batch(spark, tmp_path, rocks):
    """Three files with rows out of order inside the allowed lateness; a last one closes all runs."""
    pings = views.pings(spark, D).select("maid", "seq", "timestamp", "longitude", "latitude")
    lo, hi = pings.agg(F.min("timestamp"), F.max("timestamp")).first()
    third = (F.col("timestamp") - lo) / ((hi - lo + 1) / 3)
    mixed = F.when(F.col("seq") % 3 == 0, F.least(third + 0.001, F.lit(2.999))).otherwise(third)  # some come a little later than others
    batches = [pings.filter(F.floor(mixed) == k) for k in range(3)] + [rows_of(spark, [("later", hi + 10**7, 0, 0)])]
    got = run(live.line_segments(stream_of(spark, tmp_path, batches), late="2 hours"), "gap_lines", tmp_path)
    text = lambda df: sorted(map(str, df.select("maid", "kind", "segment", "n", "start", "end", "label", "coordinates").collect()))
    want = text(traces.line_segments(pings))
    assert text(got) == want and len(want) > 100


def test_runs_close_by_the_watermark_and_late_pings_are_left_out(spark, tmp_path, rocks):
    a = [("a", 100, 1, 1), ("a", 600, 1, 2), ("b", 100, 5, 5)]
    b = [("c", 20_000, 0, 0)]  # the watermark passes a's run: it is sent before a is seen again
    c = [("a", 300, 9, 9), ("a", 21_000, 2, 2), ("a", 21_060, 2, 3), (None, 21_000, 3, 3), (None, 21_001, 3, 4)]
    got = run(live.line_segments(stream_of(spark, tmp_path, [rows_of(spark, x) for x in (a, b, c, LATER)]), late="10 minutes"), "late_lines", tmp_path)
    lines = sorted((str(r.maid), r.kind, r.segment, r.n, r.start, r.end, r.label) for r in got.collect())
    assert lines == [("None", "move", 0, 2, 21_000, 21_001, ""), ("a", "gap", 1, 2, 600, 21_000, "+5h 40m"), ("a", "move", 0, 2, 100, 600, ""), ("a", "move", 1, 2, 21_000, 21_060, "")]


def test_speeds_in_order(spark, tmp_path, rocks):
    """Pings that come late but in time are flagged as the batch form flags them; those without a time are passed on."""
    pings = views.pings(spark, D).select("maid", "seq", "timestamp", "longitude", "latitude")
    half = pings.agg(F.percentile("timestamp", F.lit(0.5))).first()[0]
    late = (F.col("seq") % 5 == 0) & (F.col("timestamp") > half - 1500)
    batches = [pings.filter((F.col("timestamp") < half) & ~late), pings.filter((F.col("timestamp") >= half) | late), rows_of(spark, [("a", None, 1, 1), *LATER])]
    got = run(live.speed_outliers(stream_of(spark, tmp_path, batches), late="1 hour"), "in_order", tmp_path)
    want = {r.seq for r in clean.speed_outliers(pings).filter("is_outlier").collect()}
    assert {r.seq for r in got.filter("is_outlier").collect()} == want and got.filter("timestamp IS NULL").count() == 1


def test_a_late_ping_does_not_turn_the_state_back(spark, tmp_path, rocks):
    first = rows_of(spark, [("a", 1000, 0, 0)])
    late = rows_of(spark, [("a", 500, 5, 5), ("a", None, 7, 7)]).withColumn("seq", F.col("seq") + 10)
    then = rows_of(spark, [("a", 1600, 0.001, 0)]).withColumn("seq", F.col("seq") + 20)
    got = run(live.speed_outliers(stream_of(spark, tmp_path, [first, late, then])), "no_return", tmp_path)
    assert sorted((r.seq, r.is_outlier) for r in got.collect()) == [(0, False), (10, False), (11, False), (20, False)]
