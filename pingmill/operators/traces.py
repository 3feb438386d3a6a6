"""Device traces: gap-segmented lines, points, selections, and the viewer's lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.functions.geo import haversine_km
from pingmill.operators import tiles

DAY = 86400


def segment_parts(pings: DataFrame, gap_min: float = 30, keys=("maid",), tile: int = tiles.WIDTH) -> DataFrame:
    """Runs of pings with gaps of at most gap_min, in parts of one time tile each: keys, segment (its number), tile, n, start, end, line
    (timestamp, seq, at), before (whether a gap precedes the part's first ping, and the ping before it).

    A row holds one tile's pings, so a device that is never silent has many rows of bounded size; `line_segments` joins them.
    """
    at = F.array(F.bround("longitude", 6), F.bround("latitude", 6))
    rows = tiles.scan(pings.withColumn("_at", at), ["timestamp", "_at"], keys, width=tile, flag=lambda p, c: c("timestamp") - p["timestamp"] > gap_min * 60)
    return rows.groupBy(*keys, "_tile", F.col("_flags").alias("segment")).agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.array_sort(F.collect_list(F.struct("timestamp", "seq", "_at"))).alias("line"),
        F.min_by(F.struct(F.col("_flag").alias("gap"), F.col("_prev.timestamp").alias("t"), F.col("_prev._at").alias("at")), F.struct("timestamp", "seq")).alias("before"),
    ).withColumnRenamed("_tile", "tile")


def line_segments(pings: DataFrame, gap_min: float = 30, label_min: float = 60, keys=("maid",), tile: int = tiles.WIDTH) -> DataFrame:
    """Runs of pings with gaps of at most gap_min are 'move' lines (two points or more); each longer gap is a 'gap' line of its two ends.

    maid, kind, segment, n, start, end, label, coordinates (lon, lat to 6 digits). Labels: +Hh MMm for gaps of label_min or more.
    """
    # The gap before a run hangs on the run's first ping, so one aggregate gives both kinds of lines.
    runs = segment_parts(pings, gap_min, keys, tile).groupBy(*keys, "segment").agg(
        F.sum("n").alias("n"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile", "line"))), lambda p: p["line"])).alias("_line"),
        F.min_by("before", "tile").alias("_f"),
    )
    before, first = F.col("_f.t"), F.col("_line")[0]["_at"]
    minutes = F.floor((F.col("start") - before) / 60).cast("long")
    label = F.when((F.col("start") - before) >= label_min * 60, F.format_string("+%dh %02dm", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)))).otherwise("")
    line = lambda kind, n, start, end, text, path: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), start.alias("start"), end.alias("end"), text.alias("label"), path.alias("coordinates"))
    move = line("move", F.col("n"), F.col("start"), F.col("end"), F.lit(""), F.transform("_line", lambda p: p["_at"]))
    gap = line("gap", F.lit(2), before, F.col("start"), label, F.array(F.col("_f.at"), first))
    lines = F.filter(F.array(F.when(F.col("n") >= 2, move), F.when(F.col("_f.gap"), gap)), lambda x: x.isNotNull())
    out = runs.select(*keys, "segment", F.explode(lines).alias("x"))
    return out.select(*keys, "x.kind", F.col("segment").cast("long").alias("segment"), *(f"x.{c}" for c in ("n", "start", "end", "label", "coordinates")))


def points(pings: DataFrame, keys=("maid",), tile: int = tiles.WIDTH) -> DataFrame:
    """maid, idx, time, tsec, speed_kmh (to the previous ping, 0 at first and where time stands still), lon, lat."""
    rows = tiles.scan(pings, ["timestamp", "longitude", "latitude"], keys, width=tile)
    hours = (F.col("timestamp") - F.col("_prev.timestamp")) / 3600.0
    km = haversine_km(F.col("_prev.longitude"), F.col("_prev.latitude"), F.col("longitude"), F.col("latitude"))
    speed = F.coalesce(F.when(hours > 0, km / F.nullif(hours, F.lit(0.0))), F.lit(0.0))
    tsec = F.pmod("timestamp", F.lit(DAY))
    time = F.format_string("%02d:%02d:%02d", F.floor(tsec / 3600), F.floor(tsec / 60) % 60, tsec % 60)
    return rows.select(*keys, F.col("_n").cast("long").alias("idx"), time.alias("time"), tsec.alias("tsec"), F.bround(speed, 1).alias("speed_kmh"), F.bround("longitude", 6).alias("lon"), F.bround("latitude", 6).alias("lat"))


def geojson(features: DataFrame, kind: str, coordinates: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, as text: write it with df.write.text."""
    shape = F.struct(F.lit(kind).alias("type"), F.col(coordinates).alias("coordinates"))
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value"))


def feature_collection(features: DataFrame) -> DataFrame:
    """The lines of one FeatureCollection: features as `geojson` returns them, between a head and a foot.

    One task streams them, since they make one file: df.write.text. For a few devices' traces, points or areas.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"])
        yield lines(['{"type":"FeatureCollection","features":['])
        first = True
        for batch in batches:
            values = [v for v in batch.column("value").to_pylist() if v is not None]
            yield lines([v if first and k == 0 else f",{v}" for k, v in enumerate(values)])
            first = first and not values
        yield lines(["]}"])

    # The null row keeps an empty table from being planned away: its collection has a head and a foot, too.
    rows = features.select("value").union(features.sparkSession.range(1).select(F.lit(None).cast("string")))
    return rows.coalesce(1).mapInArrow(run, "value string")


def spans(pings: DataFrame, min_pings: int = 1) -> DataFrame:
    """Diagonal of each device's bounding box."""
    box = pings.groupBy("maid").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("longitude", "latitude") for n, f in (("min", F.min), ("max", F.max))))
    span = haversine_km(F.col("longitude_min"), F.col("latitude_min"), F.col("longitude_max"), F.col("latitude_max"))
    return box.filter(F.col("n") >= min_pings).select("maid", "n", span.alias("span_km"))


def pick_top(pings: DataFrame, n: int, min_pings: int) -> DataFrame:
    return spans(pings, min_pings).orderBy(F.col("span_km").desc(), "maid").limit(n)


def pick_mix(pings: DataFrame, n: int, min_pings: int, each: int = 10) -> DataFrame:
    """One device that goes far, then medium and short ones in turn."""
    far = F.when(F.col("span_km") >= 25, "long").when(F.col("span_km") >= 5, "med").otherwise("short")
    rows = spans(pings, min_pings).withColumn("band", far)
    rank = F.row_number().over(W.partitionBy("band").orderBy(F.col("span_km").desc(), "maid"))
    rows = rows.withColumn("_r", rank).filter(F.col("_r") <= F.when(F.col("band") == "long", 1).otherwise(each))
    turn = F.when(F.col("band") == "long", 0).when(F.col("band") == "med", 2 * F.col("_r") - 1).otherwise(2 * F.col("_r"))
    return rows.withColumn("_turn", turn).orderBy("_turn").limit(n).select("maid", "band", "span_km")


def as_of(trace: DataFrame, tsec: int) -> DataFrame:
    """Each device's last point at or before a second of the day."""
    return trace.filter(F.col("tsec") <= tsec).groupBy("maid").agg(F.max_by(F.struct("idx", "tsec", "lon", "lat"), F.struct("tsec", "idx")).alias("p")).select("maid", "p.*")


def as_of_join(trace: DataFrame, times: DataFrame) -> DataFrame:
    """For every (maid, tsec) of `times`, the last point at or before it: a union and windows by tiles of an hour, no range join.

    A device's points are reduced to the last of each second of the day before anything moves.
    """
    have = trace.groupBy("maid", "tsec").agg(F.max_by(F.struct("idx", "lon", "lat"), "idx").alias("_last"))
    return tiles.last_at_or_before(have, times.select("maid", "tsec"), "_last", "tsec").select("maid", "tsec", "_last.*")


def burst_counts(trace: DataFrame, reach: float = 0.001) -> DataFrame:
    """For each point how many of its device's points lie within `reach` degrees both ways, itself included.

    Points are counted by place first; places meet through tiles of twice the reach (each is in four, or up to nine on borders), so the join has an
    equal key and the pairs of a busy place never multiply.
    """
    places = trace.groupBy("maid", "lon", "lat").agg(F.count("*").alias("k"))
    tile = lambda c: F.floor(c / F.lit(2 * reach)).cast("long")
    near = places.withColumn("tx", F.explode(F.sequence(tile(F.col("lon") - reach), tile(F.col("lon") + reach))))
    near = near.withColumn("ty", F.explode(F.sequence(tile(F.col("lat") - reach), tile(F.col("lat") + reach))))
    own = places.select("maid", F.col("lon").alias("x"), F.col("lat").alias("y"), tile(F.col("lon")).alias("tx"), tile(F.col("lat")).alias("ty"))
    close = (F.abs(F.col("lon") - F.col("x")) < reach) & (F.abs(F.col("lat") - F.col("y")) < reach)
    counts = own.join(near, ["maid", "tx", "ty"]).filter(close).groupBy("maid", F.col("x").alias("lon"), F.col("y").alias("lat")).agg(F.sum("k").alias("n_near"))
    return trace.join(counts, ["maid", "lon", "lat"])


def timeline(trace: DataFrame) -> DataFrame:
    return trace.select("tsec").distinct()


def bounds(trace: DataFrame) -> DataFrame:
    return trace.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
