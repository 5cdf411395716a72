"""Catalog queries on listings of over a thousand subjects, whose names of three digits repeat."""

import duckdb
import pytest

from spindrift.plans import registry
from tests.test_queries import rows_of

NAMES = "file_catalog catalog_runs catalog_sessions catalog_subjects catalog_select echo_sets match_runs unmatched_runs derived_names stage_files decay_names fixed_catalog existing_files".split()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    spark.range(36 * 1012 + 7, numPartitions=4).selectExpr("id as page_id", "'' as url", "'' as html").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_beyond_a_thousand_subjects(spark, many, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{many}/pages.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, many)
    got = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(got.columns, got.fetchall())
