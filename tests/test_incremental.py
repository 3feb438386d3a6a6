"""Incremental products: equal to a full run, and only touched dates are rewritten."""

import glob
import os
import random

import pytest

from pingmill.functions.cells import with_cells
from pingmill.operators import clean, contacts, homes, spatial, temporal
from pingmill.plans import incremental
from pingmill.plans.pipeline import Config
from pingmill.sources import ingest

HEADER = "maid,latitude,longitude,timestamp\n"
DAY, START = 86_400, 1_700_006_400


def month(path, first_day, days, seed, n=150):
    rnd = random.Random(seed)
    rows = [f"d{rnd.randrange(12)},{rnd.random() / 4:.4f},{rnd.random() / 4:.4f},{START + first_day * DAY + rnd.randrange(days * DAY)}\n" for _ in range(n)]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(HEADER + "".join(rows[: n // 2]) + HEADER + "".join(rows[n // 2 :]) + "d1,0.1,0.1,soon\nd2,0.1,0.1,\n")


def full(spark, raw):
    pings = with_cells(clean.clean_mobility(ingest.read_pings_csv(spark, sorted(glob.glob(f"{raw}/**/*.csv", recursive=True)))))
    known = pings.filter("date IS NOT NULL")
    return {
        "grid_daily": spatial.aggregate_grid(known, by_date=True),
        "occupancy": contacts.cell_occupancy(known),
        "daily_counts": temporal.daily_counts(known),
        "night_counts": homes.night_parts(known),
        "homes": homes.detect_homes(known),
    }


def text(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def agree(spark, raw, out):
    for name, want in full(spark, raw).items():
        got = incremental.stored_homes(spark, out) if name == "homes" else incremental.product(spark, out, name)
        assert text(got, want.columns) == text(want, want.columns), name


def files(out):
    return {p: os.stat(p).st_mtime_ns for name in ("pings", *incremental.PRODUCTS) for p in glob.glob(f"{out}/{name}/date=*/**/*.parquet", recursive=True)}


def test_products_follow_the_files(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    month(f"{raw}/a b+c.csv", 0, 3, 1)
    month(f"{raw}/deep/b.csv", 2, 3, 2)
    touched = incremental.update(spark, raw, out)
    assert len(touched) == 5
    agree(spark, raw, out)
    assert incremental.update(spark, raw, out) == []
    # One more month: only its own partitions and those of the date that it shares are written.
    before = files(out)
    month(f"{raw}/c.csv", 4, 2, 3)
    touched = {str(d) for d in incremental.update(spark, raw, out)}
    after = files(out)
    assert len(touched) == 2
    kept = {p for p in before if not any(f"date={d}" in p for d in touched)}
    assert kept and all(after.get(p) == before[p] for p in kept)
    assert {p.split("date=")[1][:10] for p in after if before.get(p) != after[p] and "__HIVE" not in p} == touched
    agree(spark, raw, out)
    # A changed file that no longer holds one of its dates, and one that goes.
    month(f"{raw}/deep/b.csv", 3, 1, 4, n=80)
    incremental.update(spark, raw, out)
    agree(spark, raw, out)
    os.remove(f"{raw}/a b+c.csv")
    gone = incremental.update(spark, raw, out)
    assert len(gone) == 3
    agree(spark, raw, out)
    assert incremental.manifest(spark, out).count() == 2


def test_a_run_that_died_is_repeated(spark, tmp_path, monkeypatch):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    month(f"{raw}/a.csv", 0, 2, 1)
    incremental.update(spark, raw, out)
    month(f"{raw}/b.csv", 1, 2, 2)
    with monkeypatch.context() as m:
        m.setattr(incremental, "_products", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            incremental.update(spark, raw, out)
    assert len(incremental.update(spark, raw, out)) == 2
    agree(spark, raw, out)


def test_buckets_over_midnight_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="midnight"):
        incremental.update(spark, str(tmp_path), str(tmp_path), Config(bucket="7h"))
