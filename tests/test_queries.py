"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from tidemill.plans import catalog


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) == "NaT":
            return None
        if hasattr(value, "isoformat"):
            return str(value)[:19].replace(" 00:00:00", "")
        return value.item() if hasattr(value, "item") else value

    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    out = duckdb.connect()
    for file in os.listdir(small):
        out.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, small, duck, name):
    mine = catalog.QUERIES[name](spark, small).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
