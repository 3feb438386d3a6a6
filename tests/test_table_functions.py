"""SQL table functions against the operators, and the roll-up over places."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.functions import table_functions
from pingmill.operators import reports, traces


def test_segments_in_sql(ping, spark):
    rows = ping([("a", t, t / 1e5 + 1.23456789e-3, 1.0000005) for t in (0, 60, 3000, 9000, 9001, 9001, 50_000)] + [("b", 7, 1, 1), (None, 1, 2, 2), (None, 2, 2, 2)])
    table_functions.register(spark)
    rows.createOrReplaceTempView("some_pings")
    got = spark.sql("SELECT * FROM trace_segments(TABLE(some_pings) PARTITION BY maid ORDER BY (timestamp, seq))")
    want = traces.line_segments(rows)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT * FROM trace_segments(TABLE(SELECT * FROM some_pings WHERE false) PARTITION BY maid ORDER BY timestamp)").count() == 0


def test_bursts_in_sql(ping, spark):
    rows = ping([("a", t, 1, 1) for t in (0, 30, 90, 151, 400, 400)] + [("b", 5, 1, 1)])
    table_functions.register(spark)
    rows.createOrReplaceTempView("burst_pings")
    got = spark.sql("SELECT * FROM burst_features(TABLE(burst_pings) PARTITION BY maid ORDER BY (timestamp, seq))").collect()
    w = W.partitionBy("maid").orderBy("timestamp", "seq")
    late = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w) > 60, F.lit(False)).cast("int")
    runs = rows.withColumn("late", late).withColumn("run", F.sum("late").over(w)).groupBy("maid", "run").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.count("*").alias("n"))
    assert sorted((r.maid, r.start, r.end, r.n) for r in got) == sorted((r.maid, r.s, r.e, r.n) for r in runs.collect())
    assert {r.n: r.mean_gap for r in got if r.maid == "a"} == {3: 45.0, 1: None, 2: 0.0}


def test_rollup_tells_missing_places_from_sums(ping, spark):
    rows = ping([("a", 1, 1, 1), ("a", 2, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, 1), (None, 1, 1, 1)])
    people = spark.createDataFrame([("a", "x", "x1"), ("b", None, "y1"), ("d", "x", "x2")], "maid string, place1 string, place2 string")
    got = {(r.level, r.place1, r.place2): (r.n_devices, r.n_pings) for r in reports.place_rollup(rows, people, ["place1", "place2"]).collect()}
    assert got == {(0, "x", "x1"): (1, 2), (0, None, "y1"): (1, 1), (0, None, None): (1, 1), (1, "x", None): (1, 2), (1, None, None): (2, 2), (3, None, None): (3, 4)}
