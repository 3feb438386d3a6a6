"""Visits of areas: the plain join's counts, and work by places of devices and different outlines, not by pings and names."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pingmill.functions import cover, geo
from pingmill.operators import spatial
from pingmill.plans import registry

DATA = "/root/testdata/sf0.001"
AREA = f"name string, ring array<{geo.POINT}>, holes array<array<{geo.POINT}>>"


def square(x, y, r):
    return [{"lon": float(a), "lat": float(b)} for a, b in ((x, y), (x + r, y), (x + r, y + r), (x, y + r))]


def plain(pings, areas):
    rows = pings.join(areas, geo.inside_area(F.col("longitude"), F.col("latitude"), F.col("ring"), F.col("holes").cast(f"array<array<{geo.POINT}>>")), "left")
    return sorted(map(tuple, rows.groupBy(F.coalesce("name", F.lit(""))).agg(F.count("*"), F.countDistinct("maid")).collect()))


@pytest.fixture
def met(monkeypatch):
    """Rows of points and of areas of each call of `within`."""
    calls, plain = [], geo.within

    def within(points, areas, *args, **options):
        calls.append((points.count(), areas.count()))
        return plain(points, areas, *args, **options)

    monkeypatch.setattr(geo, "within", within)
    return calls


def test_visits_are_the_plain_counts(spark, met):
    """Equal outlines under many names, names of more than one outline, areas called '' or without a name, devices without a name."""
    big, hole, small, far = square(0, 0, 4), square(1, 1, 2), square(3, 3, 2), square(50, 50, 1)
    rows = [(f"same{k}", big, [hole]) for k in range(30)] + [("two", big, [hole]), ("two", small, None), ("twice", small, None), ("twice", small, None), ("other two", small, None), ("other two", big, [hole])]
    rows += [("no hole", big, None), ("empty holes", big, []), ("", small, None), (None, far, None), ("nowhere", square(80, 80, 1), None), ("no ring", None, None)]
    areas = spark.createDataFrame(rows, AREA)
    rng = np.random.default_rng(3)
    some = [(f"d{rng.integers(20)}" if rng.random() < 0.9 else None, float(x), float(y)) for x, y in rng.integers(-1, 11, (500, 2)) / 2] + [("d1", 50.5, 50.5), ("d2", None, 1.0), ("d3", 2.0, None)]
    pings = spark.createDataFrame(some, "maid string, longitude double, latitude double")
    got = sorted(map(tuple, spatial.area_visits(pings, areas).collect()))
    assert got == plain(pings, areas) and {"same29", "two", "twice", "no hole", ""} <= {n for n, *_ in got} and "nowhere" not in {n for n, *_ in got}
    assert met[0][0] < len(some)
    bare = areas.filter("name LIKE 'same%'").select("name", "ring")
    assert sorted(map(tuple, spatial.area_visits(pings, bare.withColumnRenamed("name", "place"), "place").select("place", "n_pings", "n_devices").collect())) == plain(pings, bare.withColumn("holes", F.lit(None)))


def test_no_areas(spark, ping):
    pings = ping([("a", 0, 1, 1), ("b", 1, 2, 2), ("b", 2, 2, 2)])
    assert [tuple(r) for r in spatial.area_visits(pings, spark.createDataFrame([], AREA)).collect()] == [("", 3, 2)]


def test_query_looks_up_places_of_devices_and_different_outlines(spark, met, tmp_path):
    """Suppliers 1,680 keys apart have one outline; a device's pings at one place are one row."""
    suppliers, events = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("supplier", "events"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(19)))
    suppliers.withColumn("k", copies).withColumn("s_suppkey", F.col("s_suppkey") + 1680 * F.col("k")).drop("k").write.parquet(f"{tmp_path}/supplier.parquet")
    events.withColumn("k", copies).withColumn("event_id", F.col("event_id") + 2_100_000 * F.col("k")).drop("k").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.name: (r.n_pings, r.n_devices) for r in registry.queries()["area_visits"](spark, str(tmp_path)).collect()}
    assert met == [(registry.pings(spark, DATA).select("maid", "longitude", "latitude").distinct().count(), suppliers.count())]
    once = {r.name: (r.n_pings, r.n_devices) for r in registry.queries()["area_visits"](spark, DATA).collect()}
    assert {k: v for k, v in got.items() if k in once} == {k: (20 * n, d) for k, (n, d) in once.items()}
    assert len(got) == 20 * len(once) - 19


def test_areas_of_one_file_are_cut_by_all_tasks_and_many_at_a_time(spark, tmp_path):
    rows = [(f"a{k}", square(k % 20, k // 20, 0.3 + k / 2500), None) for k in range(400)]
    spark.createDataFrame(rows, AREA).coalesce(1).write.parquet(os.path.join(tmp_path, "areas"))
    cells = cover.cover(spark.read.parquet(os.path.join(tmp_path, "areas")))
    per = cells.groupBy(F.spark_partition_id()).agg(F.countDistinct("name").alias("n")).collect()
    assert len(per) == 4 and max(r.n for r in per) <= 101
    edges = np.concatenate([[(*r[k].values(), *r[(k + 1) % 4].values(), 0) for k in range(4)] for _, r, _ in rows]).astype(float)
    cut = lambda most: list(cover.split(edges, np.arange(0, 1601, 4), np.full(400, 9), 4, 8, 12, most))
    found = lambda blocks: {(a, at, x, y, inner) for b in blocks for a, at, x, y, inner in zip(*(c.tolist() for c in b[:5]), strict=True)}
    assert len(cut(2**16)) < 40 and found(cut(2**16)) == found(cut(30)) and len(found(cut(2**16))) == cells.count()


def test_slices_hold_all_areas_once(monkeypatch):
    monkeypatch.setattr(cover, "PAIRS", 10)
    sizes = [3, 3, 3, 3, 50, 1, 9, 10, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([[k] * n for k, n in enumerate(sizes)])], names=["name", "edges"])
    parts = list(cover._slices(batch))
    assert [k for p in parts for k in p.column("name").to_pylist()] == list(range(9)) and len(parts) > 3
    assert [len(p.column("edges").flatten()) for p in parts] == [sum(sizes[k] for k in p.column("name").to_pylist()) for p in parts]
    assert all(sum(sizes[k] for k in p.column("name").to_pylist()[:-1]) <= 10 for p in parts) and not list(cover._slices(batch.slice(0, 0)))
