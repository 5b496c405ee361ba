"""Every catalogue query against its SQL, over whole tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from loomlight.catalog import QUERIES
from loomlight.catalog.check import differences

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    built = QUERIES[name].build(spark, FOLDER)
    plan = built._jdf.queryExecution().executedPlan().toString()
    # No cross products and no row-at-a-time Python.
    assert [word for word in FORBIDDEN if word in plan] == []
    problems = differences(QUERIES[name], spark, FOLDER, built)
    # Only the smallest tables may lack what a query looks for.
    empty = ("the SQL gives no rows", "no rows") if FOLDER.endswith("sf0.001") else ()
    assert [p for p in problems if p not in empty] == []


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
