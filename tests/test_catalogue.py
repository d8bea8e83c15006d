"""Every query of the engine's own operators against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from rowmesh import catalogue
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
