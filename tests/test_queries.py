"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_oracles_belong_to_queries():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


SLOW = ("forecast_gbt_leaf", "forecast_gbt_depth", "refit", "benchmark_scores")  # see test_models.py


@pytest.mark.parametrize("name", [q for q in spark_entry.queries() if q not in SLOW])
def test_query(spark, con, name):
    line, good = compare(spark, con, name, SF)
    assert good or "EMPTY" in line, line


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 5
