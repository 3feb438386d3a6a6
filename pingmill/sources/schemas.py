"""Schemas of the files that are read and written; none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

RAW_PING = "maid string, latitude string, longitude string, timestamp string"
PING = "maid string, latitude double, longitude double, timestamp bigint"
PEOPLE_COLUMNS = ("maid", "sex", "col3", "col4", "country", "phone_id", "intensity", "province", "place1", "place2", "place3")
PEOPLE = ", ".join(f"{c} string" for c in PEOPLE_COLUMNS)

PRODUCTS = {
    "grid_daily": "date, cell, count",
    "concentration": "date, hhi, gini",
    "od_device_day": "maid, date, origin, dest, n_pings",
    "od_flows": "date, origin, dest, n_devices, n_pings, od_distance_km",
    "od_corridor_change": "date, origin, dest, n_devices, n_pings, od_distance_km, is_baseline, n_pings_baseline, n_pings_pct_change",
    "od_flows_district": "date, origin_place, dest_place, n_devices, n_pings",
    "od_net_flows_district": "date, pair_a, pair_b, net_n_pings",
    "homes": "maid, home_cell, n_home_pings, n_nights, home_lat, home_lon",
    "metrics_device_day": "maid, date, n_pings, n_cells, n_trips, radius_km, max_dist_home_km, stay_at_home",
    "contacts_occupancy": "bucket, cell, n_devices, n_pings",
    "meeting_index": "bucket, meeting_index",
    "meeting_index_daily": "date, meeting_index",
    "crowding": "bucket, cells_n2, cells_n5, cells_n10, cells_n20",
}


def check(df: DataFrame, product: str) -> DataFrame:
    """df with the product's columns in their order; fails if one is missing."""
    return df.select(*PRODUCTS[product].split(", "))
