"""Every query of the catalogue against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from stratagrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    want = db.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda found: sorted((tuple(map(comparable, r)) for r in found), key=repr)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0


def test_axes_are_whole(spark):
    hours = spark.read.parquet(f"{SF}/events.parquet").selectExpr("date_trunc('hour', ts) AS h").distinct().count()
    assert catalog.QUERIES["nearest_time_join"](spark, SF).count() == hours
    assert catalog.QUERIES["external_label_join"](spark, SF).where("NOT valid").count() == 0
