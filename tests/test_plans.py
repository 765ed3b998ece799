"""Physical plans: pushdown, joins, exchanges, no single-task windows."""

import pytest

from __spark_entry__ import queries
from dockyard.functions.times import ONE_DAY
from dockyard.operators.ttl import _fold
from dockyard.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_are_broadcast_by_size(spark, sf_dir):
    df = queries()["masterdata_lookup"](spark, sf_dir)
    assert plan(df).count("BroadcastHashJoin") == 2
    assert "hint" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_large_dictionary_falls_back(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(queries()["masterdata_lookup"](spark, sf_dir)).count("SortMergeJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_limit_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(queries()["limit_rows"](spark, sf_dir))


def test_range_is_a_pushed_filter(spark, sf_dir):
    text = plan(queries()["range_slice"](spark, sf_dir))
    assert "Exchange" not in text and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text


@pytest.mark.parametrize("name, columns", [
    ("project_by_name", "p_partkey:bigint,p_type:string"),
    ("url_param", "page_id:bigint,url:string"),
    ("dict_last_wins", "o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string"),
    ("batch_envelope", "o_orderkey:bigint"),
])
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["dict_last_wins", "first_match_wins", "status_board", "ttl_cache_lookup", "batch_envelope"])
def test_one_exchange(spark, sf_dir, name):
    assert plan(queries()[name](spark, sf_dir)).count("Exchange") == 1


@pytest.mark.parametrize("name", ["dict_last_wins", "status_board", "ttl_cache_lookup"])
def test_combines_before_the_shuffle(spark, sf_dir, name):
    assert "partial_max_by" in plan(queries()[name](spark, sf_dir))


def test_fold_has_one_exchange_and_one_python_pass(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS k", "ts", "event_id AS seq")
    text = plan(_fold(rows, ONE_DAY, None))
    assert text.count("Exchange") == 1 and text.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream")])
def test_no_cross_join_no_window_no_python(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    for unwanted in ["CartesianProduct", "BroadcastNestedLoopJoin", "Window", "MapInPandas"]:
        assert unwanted not in text
    # The one Python function is the linear pass over a key's sorted arrival times.
    assert all("verdicts(" in part.split(")]")[0] for part in text.split("ArrowEvalPython")[1:])
