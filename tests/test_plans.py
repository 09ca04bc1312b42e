"""Shapes of the physical plans that the design relies on."""

import pytest
from pyspark.sql import functions as F

from goldseam.jobs import REGISTRY
from goldseam.operators import profile
from goldseam.operators.infer import infer_types
from goldseam.plans import adapt, ask, gold

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for module in REGISTRY for name, query in module.QUERIES.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_both_perspectives_read_the_input_once(spark):
    text = plan(gold.mart_team_performance(adapt.matches(spark, SF)))
    assert text.count("FileScan parquet [l_") == 1


def test_scans_read_needed_columns_only(spark):
    text = plan(gold.mart_goal_analytics(adapt.goals(spark, SF)))
    assert "props" not in text and "ts#" not in text


def test_top_k_is_not_a_global_sort(spark):
    text = plan(ask.top_points(gold.mart_team_performance(adapt.matches(spark, SF)), 5))
    assert "TakeOrderedAndProject" in text


def test_filters_reach_the_scan(spark):
    from goldseam.jobs.events import retention

    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan(retention(spark, SF))


def test_profile_counts_once(spark):
    orders = adapt.table(spark, SF, "orders")
    text = final_plan(profile.profile_columns(orders, profile.numeric_kinds(orders.schema)))
    # One scan per type of column; facts and value lists share the counting.
    assert text.count("FileScan") == len({f.dataType for f in orders.schema.fields})
    assert text.count("ReusedExchange") == 2 * text.count("FileScan")
    assert "SortMergeJoin" not in text


def test_inference_shuffles_one_row_per_task(spark):
    orders = adapt.table(spark, SF, "orders").select(F.col("o_orderkey").cast("string"))
    assert "partial_min" in plan(infer_types(orders))


@pytest.mark.parametrize(
    "name", [n for n in QUERIES if n not in ("src_db_table",) and not n.startswith(("sink_", "incremental_"))]
)
def test_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text
