import hashlib
import json
import os
import struct
import time

from pyspark.sql import functions as F

from pingmill.functions import cells as cell_functions
from pingmill.functions import geo
from pingmill.functions.cells import Hexagon, Square
from pingmill.operators import contacts, traces
from pingmill.plans import pipeline
from pingmill.sources import ingest, shapes, views

HEADER = "maid,latitude,longitude,timestamp\n"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_dirty_csv_gives_the_same_rows_under_any_projection(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    write(p, HEADER + "a,1.5,2.5,100\n" + HEADER + "b,,2.5,100\nc,1.5,2.5,oops\n")
    df = ingest.read_pings_csv(spark, p)
    assert df.count() == 2 and {r.maid for r in df.select("maid").collect()} == {"a", "b"}
    assert df.filter("maid = 'b'").first().latitude is None
    ingest.mobility_csv_to_parquet(spark, p, str(tmp_path / "out"))
    assert ingest.load_mobility(spark, str(tmp_path / "out"), geom=True).first().geometry.lon == 2.5
    assert ingest.inspect_csv(spark, p, n=2).count() == 2


def test_people(spark, tmp_path):
    p = str(tmp_path / "people.csv")
    write(p, "a,\\N,x,x,x,x,high,x,P,Q,R\na,male,x,x,x,x,low,x,\\N,Q,R\n")
    ingest.people_csv_to_parquet(spark, p, str(tmp_path / "p"))
    rows = ingest.load_people(spark, str(tmp_path / "p")).orderBy("profile_no").collect()
    assert [(r.sex, r.place1) for r in rows] == [(None, "P"), ("male", None)]


def test_months(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    write(f"{raw}/Oct_2021_part1.csv", HEADER + "a,1,2,100\n")
    write(f"{raw}/x/Oct_2021_PART2.csv", HEADER + "b,1,2,100\n")
    write(f"{raw}/x/copy_part9.csv", HEADER + "b,1,2,100\n")
    write(f"{raw}/Nov_2021.csv", HEADER + "c,1,2,100\n")
    write(f"{raw}/people.csv", "z\n")
    known = {r.path.rsplit("/", 1)[1]: r for r in ingest.discover(spark, raw).collect()}
    same = hashlib.sha256((HEADER + "b,1,2,100\n").encode()).hexdigest()
    assert len(known) == 3 and "Oct_2021_PART2.csv" in known and known["Oct_2021_PART2.csv"].digest == same
    found = {r.month for r in ingest.discover(spark, raw).collect()}
    assert found == {"Oct_2021", "Nov_2021"}
    assert ingest.convert_tree(spark, raw, out) == ["Nov_2021", "Oct_2021"]
    assert ingest.convert_tree(spark, raw, out) == []
    later = time.time() + 60
    os.utime(f"{raw}/Nov_2021.csv", (later, later))
    assert ingest.convert_tree(spark, raw, out) == ["Nov_2021"]
    assert ingest.combined(spark, [f"{out}/Nov_2021", f"{out}/Oct_2021"]).count() == 3


def test_only_files_of_equal_length_are_read_for_digests(spark, tmp_path):
    raw = str(tmp_path / "raw")
    write(f"{raw}/a.csv", HEADER + "a,1,2,100\n")
    write(f"{raw}/b.csv", HEADER + "b,1,2,1000\n")
    write(f"{raw}/c.csv", HEADER + "c,1,2,1000\n")
    found = {r.path.rsplit("/", 1)[1]: r.digest for r in ingest.discover(spark, raw).collect()}
    assert found["a.csv"] is None and found["b.csv"] != found["c.csv"] and len(found["b.csv"]) == 64


def test_glob_gives_a_folder_a_file_and_all_together(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    write(f"{raw}/Oct.csv", HEADER + "a,1,2,100\n" + HEADER + "b,x,2,100\n")
    write(f"{raw}/Nov.1.csv", HEADER + "c,1,,7\n")
    both = ingest.convert_glob(spark, f"{raw}/*.csv", out)
    assert sorted((r.maid, r.longitude, r.file) for r in both.collect()) == [("a", 2.0, "Oct"), ("c", None, "Nov.1")]
    assert [r.maid for r in spark.read.parquet(f"{out}/file=Oct").collect()] == ["a"]


def wkb(kind, *parts, order="<"):
    return struct.pack(order + "BI", order == "<", kind) + b"".join(parts)


def ring_bytes(points, order="<"):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "dd", *p) for p in points)


def test_geoparquet(spark, tmp_path):
    point = struct.pack("<dd", 110.5, -7.5)
    rows = [(1, wkb(1, point)), (2, wkb(1, struct.pack(">dd", 1.0, 2.0), order=">")), (3, None), (4, wkb(1, struct.pack("<dd", float("nan"), float("nan")))), (5, wkb(0x20000001, struct.pack("<I", 4326), point)), (6, wkb(2, struct.pack("<I", 0)))]
    spark.createDataFrame(rows, "id int, geometry binary").write.parquet(str(tmp_path / "points"))
    got = {r.id: r.geometry and tuple(r.geometry) for r in shapes.read_geoparquet(spark, str(tmp_path / "points")).collect()}
    none = (None, None)
    assert {k: v or none for k, v in got.items()} == {1: (110.5, -7.5), 2: (1.0, 2.0), 3: none, 4: none, 5: (110.5, -7.5), 6: none}
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    polygon = wkb(3, struct.pack("<I", 2), ring_bytes(square), ring_bytes(hole))
    many = wkb(6, struct.pack("<I", 2), wkb(3, struct.pack("<I", 1), ring_bytes(square)), wkb(3, struct.pack(">I", 1), ring_bytes(hole, ">"), order=">"))
    spark.createDataFrame([("p", polygon), ("m", many), ("x", wkb(1, point))], "name string, geometry binary").write.parquet(str(tmp_path / "areas"))
    areas = shapes.read_geoparquet(spark, str(tmp_path / "areas"), areas=True)
    assert sorted((r.name, len(r.ring), len(r.holes)) for r in areas.collect()) == [("m", 5, 0), ("m", 5, 0), ("p", 5, 1)]
    points = spark.createDataFrame([(3.0, 3.0), (1.5, 1.5), (1.0, 1.5), (4.0, 2.0), (9.0, 9.0)], "longitude double, latitude double")
    assert [r.name for r in geo.within(points, areas.filter("name = 'p'")).orderBy("longitude").collect()] == ["", "", "p", "", ""]


def test_geojson_areas(spark, tmp_path):
    square, hole = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    features = [("p", "Polygon", [square, hole]), ("m", "MultiPolygon", [[square], [hole]]), ("x", "Point", [1, 2])]
    text = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n, "k": 1}, "geometry": {"type": t, "coordinates": c}} for n, t, c in features]}
    write(str(tmp_path / "a.geojson"), json.dumps(text, indent=1))
    areas = shapes.read_geojson(spark, str(tmp_path / "a.geojson"))
    assert sorted((r.name, len(r.ring), len(r.holes), r.ring[1].lon) for r in areas.collect()) == [("m", 5, 0, 2.0), ("m", 5, 0, 4.0), ("p", 5, 1, 4.0)]


def test_sql_cell_functions(spark):
    for index in (Square(0.05), Hexagon(0.03)):
        cell_functions.register(spark, index)
        points = spark.range(200).select((F.rand(1) * 4 - 2).alias("longitude"), (F.rand(2) * 4 - 2).alias("latitude"))
        rows = cell_functions.with_cells(points, index)
        lon, lat = index.centre(F.col("cell"))
        sql = "ping_cell(longitude, latitude) AS c", "cell_centroid_lon(cell) AS x", "cell_centroid_lat(cell) AS y", "cell_boundary(cell) AS b"
        for r in rows.select("cell", lon.alias("lon"), lat.alias("lat"), index.outline(F.col("cell")).alias("ring"), *map(F.expr, sql)).collect():
            assert r.c == r.cell and abs(r.x - r.lon) < 1e-12 and abs(r.y - r.lat) < 1e-12
            assert all(abs(p.lon - q.lon) < 1e-12 and abs(p.lat - q.lat) < 1e-12 for p, q in zip(r.b, r.ring, strict=True))


def test_polygons(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    area = spark.createDataFrame([("s", [{"lon": x, "lat": y} for x, y in square])], f"name string, ring array<{geo.POINT}>")
    # Nothing on an edge or a corner is within, on any side.
    edges = [(0.5, 0.0), (0.0, 0.5), (0.0, 0.0), (1.0, 0.5), (0.5, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]
    pts = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (-0.1, -0.1), (0.99, 0.01), *edges], "longitude double, latitude double")
    assert {(r.longitude, r.latitude) for r in geo.within(pts, area).collect() if r.name} == {(0.5, 0.5), (0.99, 0.01)}
    assert geo.clip(area, 0.5, 0.5, 2, 2).count() == 1 and geo.clip(area, 1.5, 0.5, 2, 2).count() == 0
    ring = [(0.0, 0.0), (0.5, 0.0001), (1.0, 0.0), (1.0, 1.0), (0.5, 1.0001), (0.0, 1.0)]
    wavy = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in ring],)], f"ring array<{geo.POINT}>")
    assert len(wavy.select(geo.simplify(F.col("ring")).alias("r")).first().r) == 4
    geo.register(spark)
    assert round(spark.sql("SELECT haversine_km(0D, 0D, 0D, 1D) AS k").first().k, 3) == 111.195


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    tables = pipeline.build_all(views.pings(spark, d), views.people(spark, d))
    assert len(tables) == 15
    pipeline.write_all({k: tables[k] for k in ("homes", "crowding", "od_net_flows_district")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/homes").count() == tables["homes"].count() > 0


def test_times_reach_the_scan(spark):
    plan = views.pings(spark, "/root/testdata/sf0.001").filter("date = DATE'2024-01-03'").select("maid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), " in plan and "GreaterThanOrEqual(ts,2024-01-03" in plan and "LessThan(ts,2024-01-04" in plan


def with_a_later_ping(spark, tmp_path, rows):
    """The rows as a stream of two files; the second holds one ping a week later, so that every earlier window is let go."""
    src = rows.withColumn("at", F.timestamp_seconds("timestamp"))
    src.coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    last = src.orderBy(F.col("at").desc()).limit(1).withColumn("at", F.col("at") + F.expr("INTERVAL 7 DAYS")).withColumn("maid", F.lit("later"))
    last.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    later = time.time() + 60
    for name in os.listdir(tmp_path / "in" / "1"):
        os.utime(tmp_path / "in" / "1" / name, (later, later))
    return spark.readStream.schema(src.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(df, name, tmp_path):
    run = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    run.awaitTermination(180)


def test_streaming_occupancy_equals_batch(spark, tmp_path):
    from pingmill.streaming import live

    rows = views.pings(spark, "/root/testdata/sf0.001")
    finish(live.occupancy(with_a_later_ping(spark, tmp_path, rows)), "occ", tmp_path)
    got = {(int(r.t), r.cell): (r.n_devices, r.n_pings) for r in spark.sql("SELECT unix_seconds(bucket.start) AS t, cell, n_devices, n_pings FROM occ").collect()}
    want = {(r.bucket, r.cell): (r.n_devices, r.n_pings) for r in contacts.cell_occupancy(cell_functions.with_cells(rows)).collect()}
    assert got == want and len(got) > 100


def test_streaming_sliding_counts_equal_batch(spark, tmp_path):
    from pingmill.streaming import live

    rows = views.pings(spark, "/root/testdata/sf0.001").filter("seq % 5 = 0")
    finish(live.sliding_counts(with_a_later_ping(spark, tmp_path, rows)), "slides", tmp_path)
    got = {(int(r.t), r.cell): r.n_pings for r in spark.sql("SELECT unix_seconds(bucket.start) AS t, cell, n_pings FROM slides").collect()}
    want = {}
    for r in cell_functions.with_cells(rows).select("timestamp", "cell").collect():
        for k in range(4):
            start = r.timestamp - r.timestamp % 900 - 900 * k
            want[start, r.cell] = want.get((start, r.cell), 0) + 1
    assert got == want


def test_streaming_sessions_equal_batch(spark, tmp_path):
    """Sessions are the runs of pings between gaps of over 30 minutes (an exact gap of 30 minutes joins)."""
    from pingmill.streaming import live

    rows = views.pings(spark, "/root/testdata/sf0.001")
    finish(live.sessions(with_a_later_ping(spark, tmp_path, rows)), "visits", tmp_path)
    got = sorted((r.maid, r.a, r.b, r.n_pings) for r in spark.sql("SELECT maid, unix_seconds(session.start) AS a, unix_seconds(session.end) - 1800 AS b, n_pings FROM visits WHERE maid <> 'later'").collect())
    times, want = {}, []
    for r in rows.select("maid", "timestamp").collect():
        times.setdefault(r.maid, []).append(r.timestamp)
    for maid, ts in times.items():
        run = []
        for t in sorted(ts):
            if run and t - run[-1] > 1800:
                want.append((maid, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((maid, run[0], run[-1], len(run)))
    assert got == sorted(want)


def test_as_of_join(ping, spark):
    t = traces.points(ping([("a", 10, 1, 1), ("a", 20, 2, 2)]))
    times = spark.createDataFrame([("a", 5), ("a", 10), ("a", 99)], "maid string, tsec long")
    assert [(r.tsec, r.idx) for r in traces.as_of_join(t, times).orderBy("tsec").collect()] == [(5, None), (10, 0), (99, 1)]


def test_streaming_speed_filter_equals_batch(spark, tmp_path):
    from pingmill.operators import clean
    from pingmill.streaming import live

    d = "/root/testdata/sf0.001"
    p = views.pings(spark, d).select("maid", "seq", "timestamp", "longitude", "latitude")
    half = p.agg(F.median("timestamp")).first()[0]
    for k, part in enumerate((F.col("timestamp") < half, F.col("timestamp") >= half)):  # the second file continues from the state of the first
        p.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(p.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = live.speed_outliers(stream).writeStream.format("memory").queryName("fast").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        run.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.seq for r in spark.sql("SELECT seq FROM fast WHERE is_outlier").collect()}
    assert got == {r.seq for r in clean.speed_outliers(p).filter("is_outlier").collect()}


def test_streaming_ingest_equals_batch(spark, tmp_path):
    """The same rows as the batch reader on dirty files: leaked headers, empty and unreadable values."""
    from pingmill.streaming import live

    raw, args = str(tmp_path / "raw"), (str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "ck"))
    write(f"{raw}/a.csv", HEADER + "a,1.5,2.5,100\n" + HEADER + "b,oops,2.5,100\nc,1.5,2.5,\nd,1.5,2.5,soon\n")
    live.ingest(spark, *args).awaitTermination(60)
    write(f"{raw}/b.csv", HEADER + "e,,2.5,100\n")
    live.ingest(spark, *args).awaitTermination(60)
    live.ingest(spark, *args).awaitTermination(60)  # nothing new
    got = sorted(map(str, spark.read.parquet(args[1]).collect()))
    assert got == sorted(map(str, ingest.read_pings_csv(spark, f"{raw}/*.csv").collect()))
    assert {r.maid for r in spark.read.parquet(args[1]).collect()} == {"a", "c", "e"}


def test_feature_collection(ping, spark, tmp_path):
    lines = traces.geojson(traces.line_segments(ping([("a", 0, 1, 2), ("a", 60, 1.5, 2), ("b", 0, 1, 1), ("b", 9, 1, 1)])), "LineString", "coordinates", ["maid", "kind"])
    for k, rows in enumerate((lines, lines.limit(0))):
        traces.feature_collection(rows).write.text(str(tmp_path / f"{k}"))
        files = [f for f in os.listdir(tmp_path / f"{k}") if f.startswith("part-")]
        found = json.loads("".join(open(tmp_path / f"{k}" / f).read() for f in files))
        assert found["type"] == "FeatureCollection" and sorted(f["properties"]["maid"] for f in found["features"]) == (["a", "b"] if k == 0 else [])
