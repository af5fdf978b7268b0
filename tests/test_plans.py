"""The physical plans keep the properties that matter at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.dedup import keep_highest
from tallyloom.operators.lookup import canonical_customers, convert_amounts, customer_mapping, latest_rates, with_base_rate
from tallyloom.workload.queries import all_queries
from tallyloom.workload.views import table, view


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_dedup_limits_groups_before_the_exchange(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,4)"))
    text = plan(keep_highest(lines, ["l_orderkey", "l_linenumber"], "amount", ["l_partkey", "l_suppkey"]))
    partial, exchange = text.index(", Partial"), text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text and partial > exchange


def test_small_references_are_broadcast(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("customer_name"), F.col("l_linestatus").alias("currency"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("amount_numeric"))
    named = canonical_customers(lines, customer_mapping(spark))
    text = plan(convert_amounts(named, latest_rates(with_base_rate(view(spark, sf_dir, "fx_rates")))))
    assert text.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in text


def test_scan_reads_only_what_is_used(spark, sf_dir):
    text = plan(all_queries()["dim_code_list"](spark, sf_dir), "formatted")
    assert "ReadSchema: struct<p_type:string>" in text


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_cross_join_no_python_no_single_task_window(spark, sf_dir, name):
    text = plan(all_queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "ExistingRDD"):
        assert bad not in text
    for line in text.splitlines():
        if " Window [" in line:
            assert "], []," not in line and "windowspecdefinition(specified" not in line
