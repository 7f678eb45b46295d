"""Every registered query against its SQL over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lavka.plans.oracle import ORACLE as SQL
from lavka.plans.registered import QUERIES
from lavka.plans.views import SOURCES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in SOURCES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert QUERIES.keys() <= entry.queries().keys() and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    order = [columns.index(c) for c in sorted(columns)]
    expected = sorted(str(tuple(r[i] for i in order)) for r in result.fetchall())
    assert sorted(str(tuple(r[c] for c in sorted(columns))) for r in found.collect()) == expected


LAZY = ["order_list", "order_documents", "catalog_search", "catalog_cards", "clean_products", "clean_orders",
        "constraint_audit", "items_strict", "products_updated", "role_capabilities", "signin_matches"]


@pytest.mark.parametrize("name", LAZY)
def test_plan_stays_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_order_list_plan(spark):
    """Items are shuffled once, and only the columns in use are read."""
    plan = QUERIES["order_list"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line]
    assert scans and not any("l_tax" in line or "l_returnflag" in line for line in scans)


def test_dimension_joins_do_not_shuffle_products(spark):
    plan = QUERIES["catalog_by_supplier"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert "EqualTo(s_name,Supplier#000000001)" in plan
