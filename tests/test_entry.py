import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["degree_gini", "flip_threshold_sweep", "kendall", "crossing_density_chord", "bootstrap_mean_ci", "column_dictionary", "latest_per_key"])
def test_query_equals_its_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    want = c.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    order = list(got.columns)
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and bool(((a == b) | (a.isna() & b.isna())).all().all())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
