"""Steps whose work must not grow faster than their input, and their results on repeated and empty keys."""

from __future__ import annotations

import datetime
import pathlib

import pytest

from tallyloom.operators.dedup import dedup_summary, first_source_summary, flag_repeats
from tallyloom.operators.orphans import settle_arrival, settled_facts
from tallyloom.operators.reshape import unpivot_dates
from tallyloom.session import SQL_SETTINGS
from tallyloom.sources import landing
from tallyloom.workload import views
from tallyloom.workload.queries import all_queries


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Repeated and empty keys, one order of many lines, months outside the layout, missing dates and prices."""
    path = str(tmp_path_factory.mktemp("odd-tables"))
    day = lambda i: None if i % 11 == 0 else datetime.datetime(1994 + i % 9, 1 + i % 12, 1 + i % 28)
    price = lambda i: None if i % 13 == 0 else 100.25 * (i % 40)
    lines = [(None if i % 17 == 0 else (1 if i % 2 else i % 9), i % 7 if i % 19 else None, i % 5, i % 6, float(i % 50), price(i), day(i)) for i in range(600)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
        "orders": ([(1, 1), (1, 1), (1, 2), (2, 1), (3, None), (None, 1), (4, 3), (5, 3), (6, 9)], "o_orderkey long, o_custkey long"),
        "customer": ([(1, "A", 1, "X"), (2, "A", 1, "X"), (3, None, None, None), (3, "C", 2, "Y"), (None, "D", 3, "Z")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "part": ([(0, "T"), (1, "T"), (2, "U"), (2, "U"), (3, None), (4, "V"), (None, "W")], "p_partkey long, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(views.SPARK_VIEWS))
def test_views_built_for_spark_hold_the_rows_of_the_shared_text(spark, odd_tables, name):
    built, shared = views.view(spark, odd_tables, name), views.run_sql(spark, odd_tables, views.VIEWS[name])
    assert built.schema.simpleString() == shared.schema.simpleString()
    assert shared.count() > 0
    assert built.exceptAll(shared).isEmpty() and shared.exceptAll(built).isEmpty()


def test_no_row_of_a_sum_for_every_month_is_aggregated(spark, odd_tables):
    plan = unpivot_dates(views.view(spark, odd_tables, "fin_wide"))._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate" in line]
    assert aggregates and all(line.count("sum(") + line.count("collect_list(") <= 1 for line in aggregates)


def test_stages_keep_to_methods_that_the_jvm_compiles(spark):
    assert int(SQL_SETTINGS["spark.sql.codegen.hugeMethodLimit"]) <= 8000


def test_costs_are_shuffled_by_order_once(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # the customer mapping alone is below
    try:
        plan = all_queries()["silver_financial"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above_joins = plan[: plan.index("Union")]
    assert "Window [" in above_joins and "Exchange hashpartitioning(order_no" not in above_joins


def test_rows_of_one_arrival_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    moved = []
    monkeypatch.setattr(landing, "_spread", lambda df, partitions: moved.append(partitions) or df)
    facts, parents = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), spark.createDataFrame([("a",)], "k string")
    settle_arrival(spark, facts, parents, parents, str(tmp_path / "t"), "k", 0)
    assert not moved
    rows = settled_facts(spark, str(tmp_path / "t"), ["k", "v"]).collect()
    assert {(r["k"], r["v"], r["state"]) for r in rows} == {("a", 1, "MATCHED"), ("b", 2, "ORPHANED"), (None, 3, "ORPHANED")}


def test_landed_pages_and_written_tables_are_compressed(spark, sf_dir):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    seen = set(shared.glob("tallyloom-order-*"))
    assert all_queries()["orders_pipeline"](spark, sf_dir).count() > 0
    new = set(shared.glob("tallyloom-order-*")) - seen
    files = [f.name for folder in new for f in folder.rglob("part-*")]
    assert files and all(f.endswith((".gz", ".zstd.parquet")) for f in files)


@pytest.mark.parametrize("name, others", [("reconcile_costs", ()), ("dedup_summary", ("_set#", "SOURCE_FILE#"))])
def test_both_layouts_meet_where_the_order_join_left_them(spark, sf_dir, name, others):
    """Above the union of the layouts no cleaned row is shuffled again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # the customer mapping alone is below
    try:
        plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [line.split("hashpartitioning(")[1] for line in plan[: plan.index("Union")].splitlines() if "Exchange hashpartitioning" in line]
    assert all(s.startswith(others) for s in shuffles)


def test_the_summary_by_first_source_takes_null_and_empty_keys_as_equal(spark):
    keys = [None, "", "a", "b"]
    rows = [(keys[i % 4], keys[i // 4 % 4], ["x", "y", "z"][i % 3], i if i % 5 else None, f"s{i:02d}") for i in range(48)]
    df = spark.createDataFrame(rows, "k string, other string, SOURCE_FILE string, at int, name string")
    for columns in (["k"], ["k", "other"], ["at", "k"]):
        fast, flagged = first_source_summary(df, columns, ["name"]), dedup_summary(flag_repeats(df, columns, ["name"]))
        names = ["SOURCE_FILE", "DROPPED_COUNT", "KEPT_COUNT", "LOG_TYPE"]
        assert sorted(map(tuple, fast.select(names).collect())) == sorted(map(tuple, flagged.select(names).collect()))
