"""Registered queries against DuckDB on the smallest data set (a spread of them; the compare tool runs all)."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from sitewright.catalog.site_views import TABLES
from tools_compare import normal

SF = "/root/testdata/sf0.001"
SPREAD = ("checks_head_and_meta", "links_per_page", "checks_images", "template_clusters", "score_root_causes", "compare_urls", "maturity_categories", "sitemap_reconciliation", "extract_json_ld", "fn_url_normalize", "frontier_attempts", "table_upsert")


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for table in TABLES:
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return base


@pytest.mark.parametrize("name", SPREAD)
def test_matches_duckdb(spark, duck, name):
    got, want = normal(contract.queries()[name](spark, SF).toPandas()), normal(duck.sql(contract.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_text_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns[:2] == ["run_id", "check_id"]


def test_registration_needs_no_session():
    """Queries and texts are listed before there is a session."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(contract.__file__), capture_output=True, text=True, check=True)
    assert int(found.stdout.split()[-1]) >= 200
