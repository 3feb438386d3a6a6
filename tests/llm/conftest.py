import pytest


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        full = [r if isinstance(r, tuple) and len(r) == 5 else (*r, *([None] * (5 - len(r)))) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes DataFrames as the tables of a folder that queries read."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
