"""Every registered query against its DuckDB SQL, on the smallest tables.

The physical plan is checked as well.
"""

import pytest

import __spark_entry__ as contract
from check_oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")  # products, row-at-a-time Python
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    result = contract.queries()[name](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in NEVER)
    got = result.toPandas()
    if name in ORACLE:
        assert compare(got, con.execute(ORACLE[name]).df()) == "ok"
    else:
        assert len(got)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(contract.queries())


def test_entry_reports_every_split(spark):
    rows = contract.entry(spark).collect()
    assert {r["split"] for r in rows} == {"IID", "NEAR", "FAR"}
    assert {r["metric"] for r in rows} >= {"roc_auc", "pr_auc_outlier", "pr_auc_inlier"}
