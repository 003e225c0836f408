"""Every registered query against its SQL, and rules all plans keep."""

import pytest

import __spark_entry__ as contract
from adloom.bindings import oracle
from adloom.bindings import queries as bound
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def db(tables):
    return connect(tables)


def test_each_query_has_sql():
    assert bound.queries().keys() == oracle.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", list(bound.queries()))
def test_query_matches_sql(spark, db, tables, name):
    assert compare(spark, db, tables, name).startswith("same")


@pytest.mark.parametrize("name", list(bound.queries()))
def test_plan_rules(spark, tables, name):
    plan = contract.queries()[name](spark, tables)._jdf.queryExecution().toString()
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]:
        assert operator not in plan
    # windows without keys run only over one row per segment, sums over one row per task
    if "Exchange SinglePartition" in plan:
        assert name in ("position_quantile", "ordered_report", "large_users")


def test_entry(spark):
    assert contract.entry(spark).columns == ["site_id", "n", "p", "users"]
