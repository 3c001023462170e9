"""Every registered query against its SQL twin in DuckDB (sf0.001 here; the
driver runs the same check at sf0.01)."""

from __future__ import annotations

import os

import pytest

from oracle_check import compare, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def _names():
    from storefront.plans.registry import queries
    return sorted(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    r = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert r["status"] in ("ok", "no-oracle"), r


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns[:2] == ["product_id", "title"]
    assert len(df.collect()) == 10
