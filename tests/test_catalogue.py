import re

import pytest

from attestry.plans import catalogue

from .comparing import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = spark_rows(df)
    if name not in catalogue.SQL:
        assert got
        return
    cols, want = sql_rows(db, catalogue.SQL[name])
    assert sorted(df.columns) == cols
    assert got == want


def test_ranges_reach_the_scan(spark):
    """Numeric filters over float columns and text filters are in the Parquet scan, and only the columns asked for are read."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = catalogue.QUERIES["filter_conjunction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    for part in ("GreaterThanOrEqual(l_quantity,9.9", "LessThanOrEqual(l_quantity,20.0", "EqualTo(l_returnflag,R)", "GreaterThanOrEqual(l_discount,0.00"):
        assert part in pushed, pushed
    assert "l_tax" not in re.search(r"ReadSchema: struct<(.*?)>", plan)[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
