import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "Asia/Jakarta")  # results must not depend on it
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def ping(spark):
    """Pings from (maid, seconds, lon, lat[, seq]) tuples, with cells of 0.05 degrees."""
    from pingmill.functions.cells import with_cells
    from pingmill.operators.clean import clean_mobility

    def make(rows):
        full = [(m, t, float(x), float(y), rest[0] if rest else i) for i, (m, t, x, y, *rest) in enumerate(rows)]
        df = spark.createDataFrame(full, "maid string, timestamp long, longitude double, latitude double, seq long")
        return with_cells(clean_mobility(df))

    return make
