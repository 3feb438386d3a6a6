"""Named queries over the ping tables. `oracle` asks the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.functions import cells as cell_functions
from pingmill.functions import geo, table_functions
from pingmill.functions.cells import Hexagon, Square, with_cells
from pingmill.functions.globe import Globe
from pingmill.operators import clean, contacts, distinct, homes, metrics, od, reports, spatial, temporal, traces
from pingmill.plans import oracle
from pingmill.sources import ingest, views

Query = Callable[[SparkSession, str], DataFrame]
INDEX, HEX, GLOBE, COARSE = Square(0.05), Hexagon(0.03), Globe(1500), 300
BASELINE, LEVELS, INTENSITY = 7, "place1", ["high", "medium", "low"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
#: Named areas in degrees for the point-in-polygon query.
AREAS = {
    "north": [(110.0, -8.0), (110.4, -8.0), (110.4, -7.7), (110.0, -7.7)],
    "wedge": [(110.41, -8.19), (110.83, -8.01), (110.52, -7.63)],
    "bay": [(110.03, -8.23), (110.37, -8.23), (110.37, -8.02), (110.2, -8.11), (110.03, -8.02)],
}
BOX = (110.2, -8.1, 110.6, -7.8)
CLIP = (110.38, -8.3, 110.5, -8.1)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, integers to long, dates as text: what two engines can be held to."""
    kinds = {"double": lambda c: F.round(c, 6), "int": lambda c: c.cast("long"), "date": lambda c: c.cast("string")}
    return df.select(*(kinds.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes))


def pings(spark: SparkSession, d: str) -> DataFrame:
    return views.pings(spark, d)


def cells(spark: SparkSession, d: str) -> DataFrame:
    return with_cells(pings(spark, d), INDEX)


def first_profiles(spark: SparkSession, d: str) -> DataFrame:
    return clean.profiles(clean.clean_people(views.people(spark, d)))


def globe_rollup(spark, d):
    fine = with_cells(pings(spark, d), GLOBE).groupBy("cell", "maid").agg(F.count("*").alias("n"))
    return fine.groupBy(GLOBE.coarser(F.col("cell"), COARSE).alias("cell")).agg(F.sum("n").alias("n_pings"), F.countDistinct("maid").alias("n_devices"))


def found_homes(spark, d, **options):
    return homes.detect_homes(cells(spark, d), index=INDEX, **options)


def grid(spark, d):
    return spatial.aggregate_grid(cells(spark, d), by_date=True)


def days(spark, d):
    return metrics.device_day_metrics(cells(spark, d), found_homes(spark, d))


def hourly_parts(spark, d):
    return distinct.parts(cells(spark, d), distinct.dictionary(pings(spark, d)))


def flows(spark, d):
    return od.aggregate_od(od.device_day_od(cells(spark, d)))


def place_flows(spark, d):
    cell_map = od.cell_district_map(found_homes(spark, d), clean.clean_people(views.people(spark, d)), LEVELS)
    return od.aggregate_od_by_place(od.label_flows(flows(spark, d), cell_map))


def trace(spark, d):
    return traces.points(pings(spark, d), keys=("maid",))


def areas(spark):
    rows = ", ".join(f"('{name}', array({', '.join(f'named_struct({chr(39)}lon{chr(39)}, {x}D, {chr(39)}lat{chr(39)}, {y}D)' for x, y in ring)}))" for name, ring in AREAS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, ring)")


def by_group(spark, d):
    rows = days(spark, d).join(first_profiles(spark, d).select("maid", LEVELS), "maid", "left")
    return metrics.mobility_index(metrics.daily_summary(rows, [LEVELS]), BASELINE, keys=[LEVELS])


def segments(spark, d):
    return written_out(traces.line_segments(pings(spark, d)))


def segments_in_sql(spark, d):
    table_functions.register(spark)
    call = "SELECT * FROM trace_segments(TABLE(SELECT maid, seq, timestamp, longitude, latitude FROM {pings}) PARTITION BY maid ORDER BY (timestamp, seq))"
    return written_out(spark.sql(call, pings=pings(spark, d)))


def written_out(s):
    return s.select("maid", "kind", "segment", "n", "start", "end", "label", F.array_join(F.transform("coordinates", lambda p: F.array_join(F.transform(p, lambda x: F.format_string("%.6f", x)), " ")), ";").alias("line"))


def queries() -> dict[str, Query]:
    occupancy = lambda width="1h": lambda s, d: contacts.cell_occupancy(cells(s, d), width)
    made: dict[str, Query] = {
        "ping_clean": lambda s, d: clean.clean_mobility(pings(s, d).select("seq", "maid", "latitude", "longitude", F.col("timestamp").cast("string").alias("timestamp"))).drop("datetime"),
        "speed_outliers": lambda s, d: clean.speed_outliers(pings(s, d)).filter("is_outlier").select("seq", "maid", "timestamp"),
        "speed_filtered_counts": lambda s, d: clean.filter_speed_outliers(pings(s, d)).groupBy("date").agg(F.count("*").alias("n_pings")),
        "people_clean": lambda s, d: clean.clean_people(views.people(s, d)),
        "people_profiles": lambda s, d: first_profiles(s, d).drop("profile_no"),
        "daily_counts": lambda s, d: temporal.daily_counts(pings(s, d)),
        "hourly_counts": lambda s, d: temporal.hourly_counts(pings(s, d)),
        "hourly_zero_filled": lambda s, d: temporal.hourly_zero_filled(pings(s, d)),
        "diurnal_by_hour_days": lambda s, d: temporal.diurnal_profile(pings(s, d)),
        "diurnal_overall": lambda s, d: temporal.diurnal_overall(pings(s, d)),
        "grid_daily": grid,
        "grid_total": lambda s, d: spatial.aggregate_grid(cells(s, d)),
        "grid_centroids": lambda s, d: cell_functions.centroids(cells(s, d), INDEX),
        "top_cells": lambda s, d: spatial.top_cells(spatial.aggregate_grid(cells(s, d)), 100),
        "concentration_daily": lambda s, d: spatial.concentration(grid(s, d), keys=("date",)),
        "concentration_overall": lambda s, d: spatial.concentration(spatial.aggregate_grid(cells(s, d))),
        "occupancy_1h": occupancy("1h"),
        "occupancy_30min": occupancy("30min"),
        "occupancy_7h": occupancy("7h"),
        "occupancy_7h_merged": lambda s, d: distinct.occupancy(hourly_parts(s, d), "7h"),
        "daily_counts_merged": lambda s, d: distinct.daily(hourly_parts(s, d)).select("date", "n_pings", "n_devices"),
        "meeting_index": lambda s, d: contacts.meeting_index(occupancy()(s, d)),
        "meeting_index_daily": lambda s, d: contacts.meeting_index_daily(occupancy()(s, d)),
        "crowding": lambda s, d: contacts.crowding_counts(occupancy("7h")(s, d)),
        "night_counts": lambda s, d: homes.night_counts(cells(s, d)),
        "homes": found_homes,
        "homes_all_hours": lambda s, d: found_homes(s, d, hours=None, min_nights=3),
        "device_day_metrics": days,
        "daily_summary": lambda s, d: metrics.daily_summary(days(s, d)),
        "mobility_index": lambda s, d: metrics.mobility_index(metrics.daily_summary(days(s, d)), BASELINE),
        "mobility_index_by_group": by_group,
        "stay_at_home_by_date": lambda s, d: days(s, d).groupBy("date").agg(F.avg(F.col("stay_at_home").cast("double")).alias("share")),
        "od_device_day": lambda s, d: od.device_day_od(cells(s, d)),
        "od_flows": flows,
        "od_flows_undirected": lambda s, d: od.aggregate_od(od.device_day_od(cells(s, d)), directed=False),
        "flow_distance": lambda s, d: od.flow_distance(flows(s, d), INDEX),
        "od_length_by_date": lambda s, d: od.flow_distance(flows(s, d), INDEX).groupBy("date").agg(F.avg("od_distance_km").alias("mean_km")),
        "corridor_change": lambda s, d: od.corridor_change(flows(s, d), BASELINE),
        "corridor_change_min_flow": lambda s, d: od.corridor_change(flows(s, d), BASELINE, min_flow=2.0),
        "cell_group_map": lambda s, d: od.cell_district_map(found_homes(s, d), clean.clean_people(views.people(s, d)), LEVELS),
        "od_by_place": place_flows,
        "net_flows": lambda s, d: od.net_flows(place_flows(s, d)),
        "between_places": lambda s, d: od.between_places(flows(s, d)),
        "top_corridors": lambda s, d: od.top_corridors(flows(s, d), 10),
        "trace_segments": segments,
        "trace_segments_sql": segments_in_sql,
        "trace_points": trace,
        "pick_top": lambda s, d: traces.pick_top(pings(s, d), 8, 5),
        "pick_mix": lambda s, d: traces.pick_mix(pings(s, d), 8, 5),
        "asof_lookup": lambda s, d: traces.as_of(trace(s, d), 43_200),
        "asof_join": lambda s, d: traces.as_of_join(trace(s, d), trace(s, d).select("maid").distinct().select("maid", F.explode(F.array(*(F.lit(x).cast("long") for x in (21_600, 43_200, 64_800)))).alias("tsec"))),
        "burst_count": lambda s, d: traces.burst_counts(trace(s, d)).select("maid", "idx", "n_near"),
        "timeline": lambda s, d: traces.timeline(trace(s, d)),
        "timeline_bounds": lambda s, d: traces.bounds(trace(s, d)),
        "overview_mobility": lambda s, d: reports.overview_mobility(pings(s, d)),
        "value_counts": lambda s, d: reports.value_counts(first_profiles(s, d), ["sex", "intensity", "place1"]),
        "crosstab": lambda s, d: reports.crosstab(first_profiles(s, d), "place1", "intensity", INTENSITY),
        "device_overlap": lambda s, d: reports.device_overlap(pings(s, d), first_profiles(s, d)),
        "profile_match_rate": lambda s, d: reports.match_rates(pings(s, d), first_profiles(s, d), ["sex", "intensity", "place1"]),
        "pivot_normalised": lambda s, d: reports.pivot_normalised(pings(s, d), first_profiles(s, d), "intensity", INTENSITY),
        "two_level_mean": lambda s, d: reports.two_level_mean(pings(s, d), first_profiles(s, d), "sex", "intensity", INTENSITY),
        "ping_vs_profile_share": lambda s, d: reports.share_comparison(pings(s, d), first_profiles(s, d), "place1"),
        "place_rollup": lambda s, d: reports.place_rollup(pings(s, d), first_profiles(s, d), ["place1", "place2"]),
        "clipped_histogram": lambda s, d: reports.clipped_histogram(days(s, d), "radius_km", 20.0),
        "clipped_histogram_cells": lambda s, d: reports.clipped_histogram(days(s, d), "n_cells", 50.0),
        "clipped_histogram_home": lambda s, d: reports.clipped_histogram(days(s, d), "max_dist_home_km", 30.0),
        "hexbin_planar": lambda s, d: reports.hexbin(pings(s, d), HEX),
        "hex_centroids": lambda s, d: cell_functions.centroids(with_cells(pings(s, d), HEX), HEX),
        "hex_boundaries": lambda s, d: cell_functions.boundaries(with_cells(pings(s, d), HEX), HEX).select("cell", *(F.col("ring")[k][c].alias(f"{c}{k}") for k in range(6) for c in ("lon", "lat"))),
        "grid_boundaries": lambda s, d: cell_functions.boundaries(cells(s, d), INDEX).select("cell", *(F.col("ring")[k][c].alias(f"{c}{k}") for k in range(4) for c in ("lon", "lat"))),
        "globe_daily": lambda s, d: spatial.aggregate_grid(with_cells(pings(s, d), GLOBE), by_date=True),
        "globe_centroids": lambda s, d: cell_functions.centroids(with_cells(pings(s, d), GLOBE), GLOBE),
        "globe_rollup": globe_rollup,
        "run_summary": lambda s, d: reports.run_summary(days(s, d), ["n_pings", "n_cells", "n_trips", "radius_km"]),
        "metric_quantiles": lambda s, d: reports.quantiles(days(s, d), ["n_pings", "radius_km"], [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]),
        "bbox_clip": lambda s, d: pings(s, d).filter(geo.in_box(F.col("longitude"), F.col("latitude"), *map(F.lit, BOX))).groupBy("date").agg(F.count("*").alias("n_pings")),
        "date_range_scan": lambda s, d: ingest.date_range(pings(s, d), "2024-01-03", "2024-01-05").groupBy("date").agg(F.count("*").alias("n_pings")),
        "area_clip": lambda s, d: geo.clip(views.service_areas(s, d), *CLIP).select("name"),
        "area_visits": lambda s, d: spatial.area_visits(pings(s, d), views.service_areas(s, d)),
        "point_in_polygon": lambda s, d: geo.within(pings(s, d), areas(s)).groupBy("name").agg(F.count("*").alias("n_pings")),
        "sample": lambda s, d: reports.sample(pings(s, d).select("seq", "maid"), 100),
    }
    return {k: (lambda s, d, q=q: rounded(q(s, d))) for k, q in made.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.sql(INDEX.degrees, HEX.degrees, AREAS, BOX, BASELINE, CLIP) | oracle.globe_sql(GLOBE.frequency, COARSE)
