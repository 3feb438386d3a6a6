"""All tables of a run from one ping table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pingmill.functions.cells import Square, with_cells
from pingmill.operators import clean, contacts, homes, metrics, od, spatial
from pingmill.sources.schemas import check


@dataclass(frozen=True)
class Config:
    index: object = field(default_factory=Square)
    night: tuple[int, int] | None = homes.NIGHT
    min_nights: int = 1
    baseline_days: int | Sequence[str] = 7
    level: str = "place1"
    bucket: str = "1h"
    min_flow: float | None = None
    speed_filter: bool = False


def build_all(pings: DataFrame, people: DataFrame | None = None, config: Config = Config()) -> dict[str, DataFrame]:
    """Lazy tables by name. They share one scan's plan: persist or write `pings` with cells first if several are computed."""
    if config.speed_filter:
        pings = clean.filter_speed_outliers(pings)
    cells = with_cells(pings, config.index)
    grid = spatial.aggregate_grid(cells, by_date=True)
    found = homes.detect_homes(cells, config.night, config.min_nights, config.index)
    trips = od.device_day_od(cells)
    flows = od.flow_distance(od.aggregate_od(trips), config.index)
    days = metrics.device_day_metrics(cells, found)
    occupancy = contacts.cell_occupancy(cells, config.bucket)
    out = {
        "grid_daily": grid,
        "concentration": spatial.concentration(grid, keys=("date",)),
        "od_device_day": trips,
        "od_flows": flows,
        "od_corridor_change": od.corridor_change(flows, config.baseline_days, min_flow=config.min_flow),
        "homes": found,
        "metrics_device_day": days,
        "contacts_occupancy": occupancy,
        "meeting_index": contacts.meeting_index(occupancy),
        "meeting_index_daily": contacts.meeting_index_daily(occupancy),
        "crowding": contacts.crowding_counts(occupancy),
    }
    out["mobility_index"] = metrics.mobility_index(metrics.daily_summary(days), config.baseline_days)
    if people is not None:
        known = clean.clean_people(people)
        first = clean.profiles(known)
        districts = od.aggregate_od_by_place(od.label_flows(flows, od.cell_district_map(found, known, config.level)))
        out["od_flows_district"] = districts
        out["od_net_flows_district"] = od.net_flows(districts)
        by = days.join(first.select("maid", config.level), "maid", "left")
        out[f"mobility_index_by_{config.level}"] = metrics.mobility_index(metrics.daily_summary(by, [config.level]), config.baseline_days, keys=[config.level])
    return {k: v if k.startswith("mobility_index") else check(v, k) for k, v in out.items()}


def write_all(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
