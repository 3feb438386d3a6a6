"""Exact quantiles against Spark's own, and distinct counts merged from stored bitmaps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pingmill.operators import contacts, distinct, quantiles, reports, temporal

SHARES = [0.0, 0.001, 0.3, 0.5, 0.77, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["even", "ties", "two values", "wide", "one", "few"])
def test_exact_quantiles(spark, kind):
    rnd = random.Random(4)
    n = {"one": 1, "few": 4}.get(kind, 5000)
    make = {"even": rnd.random, "ties": lambda: float(rnd.choice([1, 2, 2, 2, 3, 700])), "two values": lambda: float(rnd.randrange(2)), "wide": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300)}
    values = [make.get(kind, rnd.random)() for _ in range(n)] + [None] * 5
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i long").repartition(4)
    want = df.agg(*(F.percentile("v", F.lit(s)).alias(f"p{k}") for k, s in enumerate(SHARES))).first()
    for most, accuracy in ((10, 100), (20_000, 10_000)):
        got = quantiles.exact_quantiles(df, ["v", "i"], SHARES, most, accuracy)
        assert got["v"] == pytest.approx(list(want)) and got["i"][3] == (len(values) - 1) / 2


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, math.nan), (None, math.nan)], "a double, b double")
    got = quantiles.exact_quantiles(df, ["a", "b"], [0.0, 0.5])
    assert got["a"] == [None, None] and got["b"][0] == 1.0 and math.isnan(got["b"][1])
    assert quantiles.exact_quantiles(df.limit(0), ["b"]) == {"b": [None]}
    r = reports.run_summary(df, ["a"]).first()
    assert (r.mean_a, r.median_a) == (None, None)


def test_tasks_of_a_selection_are_bounded(spark, monkeypatch):
    """With many distinct values no more than `most` of them are ever counted out."""
    seen = []
    real = quantiles._read_off
    monkeypatch.setattr(quantiles, "_read_off", lambda rows, t: (seen.append(rows.filter(t.within()).count()), real(rows, t))[1])
    df = spark.range(300_000).select((F.rand(1) * 1e6).alias("v")).persist()
    want = df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert quantiles.exact_quantiles(df, ["v"], most=500, accuracy=1000)["v"] == [pytest.approx(want)] and max(seen) <= 500
    df.unpersist()


def test_stored_parts_merge(ping, spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"d{rnd.randrange(300)}", rnd.randrange(4 * 86_400), rnd.random() / 5, rnd.random() / 5) for _ in range(3000)] + [(None, 5, 0.01, 0.01)]
    pings = ping(rows)
    devices = distinct.dictionary(pings)
    numbers = sorted(r.device for r in devices.collect())
    assert numbers == list(range(1, len(numbers) + 1))
    distinct.parts(pings, devices).write.parquet(f"{tmp_path}/parts")
    stored = spark.read.parquet(f"{tmp_path}/parts")  # from here on no ping is read
    text = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    for width in ("1h", "7h", "2D"):
        columns = ("bucket", "cell", "n_devices", "n_pings")
        assert text(distinct.occupancy(stored, width), *columns) == text(contacts.cell_occupancy(pings, width), *columns)
    assert text(distinct.daily(stored), "date", "n_devices", "n_pings") == text(temporal.daily_counts(pings), "date", "n_devices", "n_pings")
    assert distinct.counts(stored).first().n_devices == len(numbers)
    twice = distinct.merge(distinct.merge(stored, "bucket", "cell"), "cell")
    assert text(distinct.counts(twice, "cell"), "cell", "n_devices") == text(pings.groupBy("cell").agg(F.countDistinct("maid").alias("n_devices")), "cell", "n_devices")


def test_a_dictionary_grows(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "maid string")
    old = distinct.dictionary(names("a", "b", "b", None), groups=3)
    new = {r.maid: r.device for r in distinct.dictionary(names("c", "b", "d"), old, groups=3).collect()}
    assert {k: new[k] for k in "ab"} == {r.maid: r.device for r in old.collect()} and sorted(new.values()) == [1, 2, 3, 4]


def test_many_devices_need_many_bitmaps(spark):
    """Over 32,768 devices a set has several bitmaps, which are counted together."""
    rows = spark.range(70_000).select(F.concat(F.lit("d"), F.col("id")).alias("maid"), (F.col("id") % 7200).alias("timestamp"), F.lit("x").alias("cell"))
    stored = distinct.parts(rows, distinct.dictionary(rows))
    assert stored.select("part").distinct().count() == 3 and distinct.counts(stored, "cell").first().n_devices == 70_000
