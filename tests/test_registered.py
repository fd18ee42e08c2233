"""Every registered query against its SQL on the smallest tables."""

import pytest

from gatelane.catalog import all_queries, all_sql
from tests.compare import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    state, count, detail = compare(spark, SF, QUERIES[name], SQL.get(name))
    assert state in ("ok", "rows"), (state, count, detail)
    if state == "rows":
        assert count > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


PLANNED = [n for n in QUERIES if not n.startswith(("streaming_", "train_")) and n != "dual_task_scores"]


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loop_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
