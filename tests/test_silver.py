"""Queries by device over the bucketed table: the same rows, and no exchange by device."""

import re

import pytest

from pingmill.functions.cells import with_cells
from pingmill.operators import homes, metrics, od
from pingmill.sources import silver, views

D = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS lake LOCATION '{tmp_path}/lake'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    silver.save(views.pings(spark, D), "lake.pings", buckets=4)
    yield silver.read(spark, "lake.pings")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.sql("DROP DATABASE lake CASCADE")


def text(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan), plan


def test_products_of_the_silver_table(spark, table):
    pings = with_cells(views.pings(spark, D))
    found = homes.detect_homes(pings)
    want = {"homes": found, "metrics_device_day": metrics.device_day_metrics(pings, found), "od_device_day": od.device_day_od(pings), "od_flows": od.aggregate_od(od.device_day_od(pings))}
    for name, df in silver.products(table).items():
        assert text(df, want[name].columns) == text(want[name], want[name].columns), name
        keys, plan = exchanges(df)
        assert not any("maid" in k for k in keys), (name, keys)
        assert "Bucketed: true" in plan


def test_dates_reach_the_folders(table):
    _, plan = exchanges(table.filter("date = DATE'2024-01-03'").groupBy("maid").count())
    assert re.search(r"PartitionFilters: \[[^\]]*2024-01-03", plan) and "Exchange hashpartitioning(maid" not in plan
