"""Scale invariants of every registered job's physical plan."""

import pytest

from retailkit.catalog import queries

from conftest import SF_SMALL

FOLDS = {"win11_credit_decisions", "win12_pos_stock_decisions", "chg10_transfer_fold"}


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith("str0")))
def test_no_quadratic_joins_and_python_only_in_folds(spark, name):
    plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan                       # no row-at-a-time Python UDF anywhere
    if name not in FOLDS:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan
