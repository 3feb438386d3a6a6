import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pingmill.functions.cells import Hexagon, Square
from pingmill.operators import contacts, homes, metrics, od, spatial, temporal, traces


def one(df):
    (row,) = df.collect()
    return row


def test_one_ping_day(ping):
    r = one(metrics.device_day_metrics(ping([("a", 100, 1, 1)])))
    assert (r.n_pings, r.n_cells, r.n_trips, r.radius_km, r.stay_at_home) == (1, 1, 1, 0.0, None)


def test_back_and_forth(ping):
    r = one(metrics.device_day_metrics(ping([("a", 1, 1, 1), ("a", 2, 2, 1), ("a", 3, 1, 1)])))
    assert (r.n_cells, r.n_trips) == (2, 3)


def test_device_without_home(ping):
    rows = ping([("a", 12 * 3600, 1, 1)])
    r = one(metrics.device_day_metrics(rows, homes.detect_homes(rows)))
    assert r.stay_at_home is False and r.max_dist_home_km is None


def test_night_wraps_with_both_ends(ping):
    hours = [21, 22, 5, 6]
    rows = ping([("a", h * 3600, 1, 1) for h in hours])
    assert sorted(r.hour for r in homes.at_night(rows).collect()) == [5, 22]
    assert homes.at_night(rows, None).count() == 4


def test_home_tie_goes_to_the_first_name(ping):
    rows = ping([("a", 3600, 0.01, 0.01), ("a", 7200, 0.06, 0.01)])
    assert one(homes.detect_homes(rows)).home_cell == "g0_0"
    assert homes.detect_homes(rows, min_nights=2).count() == 0


def test_same_second_goes_by_seq(ping):
    r = one(od.device_day_od(ping([("a", 5, 0.01, 0.01, 2), ("a", 5, 0.06, 0.01, 1)])))
    assert (r.origin, r.dest) == ("g1_0", "g0_0")


def test_net_flows_of_reverse_only_pairs(spark):
    f = spark.createDataFrame([("d", "b", "a", 3), ("d", "a", "c", 2), ("d", "c", "a", 5), ("d", "a", "a", 9)], "date string, origin_place string, dest_place string, n_pings long")
    assert [tuple(r) for r in od.net_flows(f).collect()] == [("d", "a", "c", -3)]
    assert {tuple(r) for r in od.net_flows(f, include_reverse_only=True).collect()} == {("d", "a", "c", -3), ("d", "a", "b", -3)}


def test_zero_baseline_is_null(spark):
    d = spark.createDataFrame([("2024-01-01", 0.0), ("2024-01-02", 5.0)], "date string, v double").selectExpr("CAST(date AS DATE) AS date", "v")
    got = metrics.mobility_index(d, 1, ["v"]).orderBy("date").collect()
    assert [(r.is_baseline, r.v_baseline, r.v_pct_change) for r in got] == [(True, 0.0, None), (False, 0.0, None)]
    named = metrics.mobility_index(d, ["2024-01-02"], ["v"]).orderBy("date").collect()
    assert [r.is_baseline for r in named] == [False, True]


def test_gini_of_known_values(spark):
    grid = spark.createDataFrame([(c,) for c in (1, 2, 2, 7, 11)], "count long")
    r = one(spatial.concentration(grid))
    assert r.gini == pytest.approx(0.434782608695652) and r.hhi == pytest.approx(179 / 529)


def test_bucket_across_midnight(ping):
    rows = ping([("a", 23 * 3600, 1, 1), ("a", 25 * 3600, 1, 1)])
    r = one(contacts.cell_occupancy(rows, "7h"))
    assert (r.bucket, r.n_devices, r.n_pings) == (21 * 3600, 1, 2)
    assert [contacts.seconds(w) for w in ("1h", "30min", "2D", "h")] == [3600, 1800, 172800, 3600]


def test_gap_labels(ping):
    t = [0, 1800, 3601, 7201, 10800]
    got = traces.line_segments(ping([("a", x, i / 10, 0) for i, x in enumerate(t)])).orderBy("start", "kind").collect()
    assert [(r.kind, r.n, r.start, r.end, r.label) for r in got] == [("move", 2, 0, 1800, ""), ("gap", 2, 1800, 3601, ""), ("gap", 2, 3601, 7201, "+1h 00m"), ("gap", 2, 7201, 10800, "")]
    assert all(len(r.coordinates) == r.n for r in got)


def test_geojson(ping):
    import json

    lines = traces.geojson(traces.line_segments(ping([("a", 0, 1, 2), ("a", 60, 1.5, 2)])), "LineString", "coordinates", ["maid", "kind"])
    f = json.loads(one(lines).value)
    assert f == {"type": "Feature", "properties": {"maid": "a", "kind": "move"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [1.5, 2.0]]}}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 200_000), st.floats(-1, 1), st.floats(-1, 1)), min_size=1, max_size=30))
def test_identities(ping, rows):
    p = ping(rows).persist()
    days, trips = metrics.device_day_metrics(p), od.device_day_od(p)
    assert days.count() == trips.count()
    assert sum(r["count"] for r in spatial.aggregate_grid(p, by_date=True).collect()) == len(rows)
    assert all(r.n_trips >= r.n_cells for r in days.collect())
    flows = od.aggregate_od(trips)
    assert sum(r.n_pings for r in od.aggregate_od(trips, directed=False).collect()) == len(rows) == sum(r.n_pings for r in flows.collect())
    occ = contacts.cell_occupancy(p)
    assert sum(r.meeting_index for r in contacts.meeting_index(occ).collect()) == sum(r.meeting_index for r in contacts.meeting_index_daily(occ).collect())
    assert all(r.cells_n2 >= r.cells_n5 >= r.cells_n10 >= r.cells_n20 for r in contacts.crowding_counts(occ).collect())
    c = one(spatial.concentration(spatial.aggregate_grid(p)))
    assert 0 <= round(c.gini, 9) < 1 and 0 < c.hhi <= 1 + 1e-9
    assert sum(r.n_pings for r in temporal.hourly_zero_filled(p).collect()) == len(rows)
    p.unpersist()


@pytest.mark.parametrize("index", [Square(0.05), Hexagon(0.03)])
def test_a_centre_lies_in_its_own_cell(spark, index):
    from pyspark.sql import functions as F

    pts = spark.range(300).select((F.rand(1) * 4 - 2).alias("x"), (F.rand(2) * 4 - 2).alias("y"))
    df = pts.select(index.cell(F.col("x"), F.col("y")).alias("c"), "x", "y")
    lon, lat = index.centre(F.col("c"))
    again = df.select("c", index.cell(lon, lat).alias("again"), F.size(index.outline(F.col("c"))).alias("n"), F.greatest(F.abs(lon - F.col("x")), F.abs(lat - F.col("y"))).alias("off")).collect()
    assert all(r.c == r.again and r.n in (4, 6) and r.off <= 0.031 for r in again)
