"""Every catalogued query against its SQL in DuckDB, at the smallest scale."""

import os

import pytest

from basalt.plans import catalog

from . import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert oracle.difference(df, duck, catalog.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0
