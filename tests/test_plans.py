"""Scale check: no cartesian product or nested-loop join anywhere, Python evaluation
only in the user-model surfaces and the two block scorers (dense and sparse); filters and column pruning reach the scans."""
import pytest

import __spark_entry__ as E
from sqlforge.plans.queries import Q

from conftest import SF_SMALL

SPARSE = ("rank_tables", "prune_columns", "fewshot_topk", "route_topk", "prompt_context", "rag_link")   # FlatMapGroupsInArrow: the list scorer
VECTORS = ("route_vectors", "rank_tables_vectors", "rag_link_vectors", "fewshot_vectors")       # the encoder and the block scorer
PYTHON_ALLOWED = {**dict.fromkeys(SPARSE, "FlatMapGroupsInArrow"), **dict.fromkeys(VECTORS, ("MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow")),
                  "batch_generate": "MapInPandas", "embed_questions": "MapInArrow", "sft_features_user": "MapInPandas"}
NAMES = sorted(Q)


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan, name
    # A nested-loop join may only appear with the small side broadcast: the per-database
    # schema table (size-checked) when the fixture's db_id is a constant and the key folds away.
    assert "BroadcastNestedLoopJoin BuildLeft" not in plan, name
    for op in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow"):
        if op in plan:
            assert op in PYTHON_ALLOWED.get(name, ()), (name, op)


def test_pushdown_and_pruning(spark):
    from pyspark.sql import functions as F
    from sqlforge.fixtures import fixture
    df = fixture(spark, SF_SMALL, "eval_rows").filter(F.col("sample_id") < 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln][0]
    assert "LessThan(o_orderkey,100)" in scan.split("PushedFilters:")[1]
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in scan
    roll = fixture(spark, SF_SMALL, "rollouts")._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in [ln for ln in roll.splitlines() if "FileScan" in ln][0]
