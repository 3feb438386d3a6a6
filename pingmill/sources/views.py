"""The ping and profile tables as views of a star schema with an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PINGS = """
SELECT event_id AS seq, CAST(user_id AS STRING) AS maid, ts,
       110.0D + ((user_id * 37) % 80) / 100.0D
         + CASE WHEN event_id % 7 = 0 THEN ((event_id * 13) % 21 - 10) / 100.0D
                WHEN event_id % 5 = 0 THEN ((event_id * 11) % 7 - 3) / 200.0D ELSE 0.0D END AS longitude,
       -8.2D + ((user_id * 53) % 60) / 100.0D
         + CASE WHEN event_id % 7 = 0 THEN ((event_id * 17) % 21 - 10) / 100.0D
                WHEN event_id % 5 = 0 THEN ((event_id * 19) % 7 - 3) / 200.0D ELSE 0.0D END AS latitude
FROM {events}
"""


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, maid, latitude, longitude, timestamp (Unix seconds), date, hour. Only the columns that a query uses are read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    rows = spark.sql(PINGS, events=events)
    at = F.col("ts").cast("timestamp_ntz")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return rows.select("seq", "maid", "latitude", "longitude", seconds.alias("timestamp"), F.to_date(at).alias("date"), F.hour(at).alias("hour"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """maid, profile_no, sex, intensity, place1, place2; missing values are the literal \\N."""
    c, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])  # both small: Spark broadcasts them by their size
    rows = rows.withColumn("profile_no", F.explode(F.array(F.lit(0), F.lit(1)))).filter("(profile_no = 0 OR c_custkey % 3 = 0) AND c_custkey % 10 <> 9")
    k = F.col("c_custkey") + F.col("profile_no")
    pick = lambda n, named: F.when(k % n == list(named)[0], named[list(named)[0]]).when(k % n == list(named)[1], named[list(named)[1]])
    return rows.select(
        F.col("c_custkey").cast("string").alias("maid"),
        "profile_no",
        pick(4, {0: "female", 3: "\\N"}).otherwise("male").alias("sex"),
        F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").when(k % 5 == 4, "\\N").otherwise("low").alias("intensity"),
        F.when(k % 6 == 0, "\\N").otherwise(F.col("r_name")).alias("place1"),
        F.col("n_name").alias("place2"),
    )


#: Corners of a service area and of its hole, in 800ths of a degree times the area's size.
AREA_RING, AREA_HOLE = ((0, 0), (8, 0), (8, 4), (4, 4), (4, 8), (0, 8)), ((1, 1), (3, 1), (3, 3), (1, 3))


def service_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, ring, holes: one area for each supplier, of a size and at a place that follow from its key; every third has a hole."""
    k = F.col("s_suppkey").cast("long")
    east, north = F.lit(110.0) + (k * 31) % 80 / F.lit(100.0), F.lit(-8.2) + (k * 47) % 60 / F.lit(100.0)
    corner = lambda x, y: F.struct((east + x * (3 + k % 7) / F.lit(800.0)).alias("lon"), (north + y * (3 + k % 7) / F.lit(800.0)).alias("lat"))
    ring = lambda corners: F.array(*(corner(x, y) for x, y in corners))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    return rows.select(F.concat(F.lit("area"), k.cast("string")).alias("name"), ring(AREA_RING).alias("ring"), F.when(k % 3 == 0, F.array(ring(AREA_HOLE))).alias("holes"))
