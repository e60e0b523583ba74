"""Each query of the catalog against its SQL, and the three functions of the driver."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ancestra.plans import catalog


def canon(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    return con


SLOW = {"clean_nodes", "clean_edges", "ppr_time_decayed", "uniform_flow", "dominator_gateway"}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_equals_its_sql(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


def test_driver_functions(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
