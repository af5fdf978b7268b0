"""Sources, sinks and whole loads, on files."""

import json
import os
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.facts import fact_kpi_actual
from tallyloom.operators.reshape import unpivot_dates, unpivot_month_names
from tallyloom.plans import financial, gold, kpi
from tallyloom.plans.orders import order_tables
from tallyloom.session import scratch_path, staged
from tallyloom.sources.landing import append_bronze, merge_latest, upsert_table, with_year_month, write_partitions
from tallyloom.sources.pages import quarantine_pages, read_pages
from tallyloom.sources.tables import parquet_copy, read_csv, read_csv_with_origin
from tallyloom.streaming.arrivals import append_new_files
from tallyloom.workload.views import PERIODS, RUN_TS, run_sql, table, view


def test_csv_keeps_text(spark, tmp_path):
    (tmp_path / "d.csv").write_text('a,b,31/01/2024\n1,,""\n"x, y", 2 ,O1\n')
    rows = read_csv(spark, str(tmp_path / "d.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", None, None), ("x, y", " 2 ", "O1")]
    assert {r["SOURCE_FILE"] for r in read_csv_with_origin(spark, str(tmp_path / "d.csv")).collect()} == {"d.csv"}
    assert parquet_copy(spark, str(tmp_path / "d.csv"), str(tmp_path / "p")).count() == 2


def land(folder, pages):
    folder.mkdir()
    for name, text in pages.items():
        (folder / name).write_text(text)
    return str(folder)


def test_pages_from_files(spark, tmp_path):
    headers = land(tmp_path / "h", {
        "p1.json": json.dumps([{"id": 1, "userId": 10, "title": "A", "body": None}, {"id": 2}]),
        "p2.json": json.dumps({"data": [{"id": 3, "userId": 11, "title": "C", "body": "note"}], "next_page": "c2"}, indent=1),
        "p3.json": json.dumps({"data": None}), "p4.json": json.dumps({"next_page": None}),
        "p5.json": '[{"id": 4}, {"id": ', "p6.json": " \n ", "p7.json": json.dumps({"data": {"id": 5}}), "p8.json": "17",
    })
    lines = land(tmp_path / "l", {
        "p1.json": json.dumps([{"id": 1, "postId": 1, "name": "n", "email": "e", "body": "b"}, {"id": 2, "postId": 77}]),
    })
    tables = order_tables(read_pages(spark, headers), read_pages(spark, lines), RUN_TS)
    orders = {r["order_id"]: r for r in tables.orders.collect()}
    assert set(orders) == {1, 2, 3}
    assert [i["line_id"] for i in orders[1]["line_items"]] == [1] and orders[2]["line_items"] == []
    assert orders[2]["customer_id"] is None and orders[3]["order_notes"] == "note"
    errors = {r["request_page"]: r["error_type"] for r in tables.errors.collect()}
    assert errors == {"p5.json": "MalformedJSON", "p6.json": "EmptyResponse", "p7.json": "ResponseFormat", "p8.json": "ResponseFormat"}
    assert json.loads(tables.bronze_headers.filter("page = 'p2.json'").first()["record_json"])["title"] == "C"


def test_quarantine_cuts_the_raw_text(spark):
    df = spark.createDataFrame([("p", "{" + "x" * 5000)], "page string, document string")
    assert len(quarantine_pages(df, "e", RUN_TS).first()["raw_response"]) == 1000


def test_bronze_keeps_every_arrival(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    append_bronze(df, str(tmp_path / "b"), "2024-01-01 00:00:00")
    append_bronze(df, str(tmp_path / "b"), "2024-01-02 00:00:00")
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == 4 and back.select("ingestion_date").distinct().count() == 2


def test_partition_rebuild_leaves_the_rest(spark, tmp_path):
    path = str(tmp_path / "g")
    rows = with_year_month(spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "period string, v int"), "period")
    write_partitions(rows, path)
    write_partitions(rows.filter("month = 2").withColumn("v", F.lit(9)), path)
    assert {(r["period"], r["v"]) for r in spark.read.parquet(path).collect()} == {("2024-01", 1), ("2024-02", 9)}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "u")
    schema = "k string, period string, v int, seq int"
    key, newest = ["k", "period"], [F.col("seq").desc()]

    def load(rows):
        upsert_table(spark, with_year_month(spark.createDataFrame(rows, schema), "period"), path, key, newest)
        return {(r["k"], r["period"]): r["v"] for r in spark.read.parquet(path).collect()}

    assert load([("a", "2024-01", 1, 1), ("b", "2024-01", 1, 1), ("a", "2024-02", 5, 1), (None, "2024-01", 7, 1)]) == {
        ("a", "2024-01"): 1, ("b", "2024-01"): 1, ("a", "2024-02"): 5, (None, "2024-01"): 7}
    change = [("a", "2024-01", 2, 1), ("a", "2024-01", 3, 2), ("c", "2024-01", 4, 1), (None, "2024-01", 8, 1)]
    expected = {("a", "2024-01"): 3, ("b", "2024-01"): 1, ("a", "2024-02"): 5, ("c", "2024-01"): 4, (None, "2024-01"): 8}
    assert load(change) == expected
    assert load(change) == expected
    assert spark.read.parquet(path).count() == len(expected)


def test_merge_keeps_the_rest(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    assert Counter(map(tuple, merge_latest(target, updates, ["k"], [F.col("seq").desc()]).collect())) == Counter([(1, "a"), (2, "y"), (3, "z")])


def test_stream_takes_new_files_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    args = (str(landing), "a string, b string", str(tmp_path / "bronze"), str(tmp_path / "ckpt"))
    (landing / "one.csv").write_text("a,b\n1,x\n")
    append_new_files(spark, *args, "2024-01-01 00:00:00")
    (landing / "two.csv").write_text("a,b\n2,y\n3,z\n")
    append_new_files(spark, *args, "2024-01-02 00:00:00")
    append_new_files(spark, *args, "2024-01-03 00:00:00")
    back = spark.read.parquet(str(tmp_path / "bronze")).collect()
    assert Counter((r["SOURCE_FILE"], str(r["ingestion_date"])) for r in back) == Counter({("one.csv", "2024-01-01"): 1, ("two.csv", "2024-01-02"): 2})


def test_scratch_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert not shared or scratch_path(spark, "x").startswith(shared)
    assert staged(spark.range(3), "t").count() == 3


def test_upsert_moves_keys_and_leaves_nothing_behind(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, seq int, year int, month int"
    latest = [F.col("seq").desc()]
    upsert_table(spark, spark.createDataFrame([(1, "a", 1, 2024, 1), (2, "b", 1, 2024, 2), (3, "c", 1, 2024, 2)], schema), path, ["k"], latest)
    before = set(os.listdir(scratch_root(spark)))
    moved = spark.createDataFrame([(1, "A", 2, 2024, 3), (1, "old", 1, 2024, 1), (2, "B", 2, 2024, 2), (4, "d", 2, None, None)], schema)
    for _ in range(2):
        upsert_table(spark, moved, path, ["k"], latest)
        rows = Counter(map(tuple, spark.read.parquet(path).select("k", "v", "year", "month").collect()))
        assert rows == Counter([(1, "A", 2024, 3), (2, "B", 2024, 2), (3, "c", 2024, 2), (4, "d", None, None)])
    assert set(os.listdir(scratch_root(spark))) <= before


def scratch_root(spark):
    return os.path.dirname(scratch_path(spark, "x").removeprefix("file:"))


def test_financial_load_accounts_for_every_row(spark, sf_dir):
    long, wide = view(spark, sf_dir, "fin_dirty"), view(spark, sf_dir, "fin_wide")
    silver = financial.silver_financial(long, wide, view(spark, sf_dir, "erp_orders"), view(spark, sf_dir, "fx_rates"), RUN_TS)
    issues = Counter(r["LOG_TYPE"] for r in silver.issues.select("LOG_TYPE").collect())
    assert silver.table.count() + issues["DUPLICATE_DROP"] == financial.combine(long, wide).count()
    assert set(issues) == {"DUPLICATE_DROP", "PERIOD_PARSE_FAIL", "AMOUNT_NOT_NUMERIC", "FX_CONVERSION_FAILED"}
    summary = financial.run_summary(silver.table).first()
    assert summary["fx_failed"] == issues["FX_CONVERSION_FAILED"]
    assert {r["LOG_TYPE"] for r in silver.changes.select("LOG_TYPE").distinct().collect()} == {"OCR_FIX", "CUSTOMER_NORM"}


@pytest.fixture(scope="module")
def kpi_silver(spark, sf_dir):
    long = view(spark, sf_dir, "kpi_long")
    return kpi.silver_kpi(long.unionByName(long), view(spark, sf_dir, "kpi_wide"), view(spark, sf_dir, "kpi_master"), kpi.YEAR, RUN_TS)


def test_kpi_load_drops_and_logs_repeats(spark, sf_dir, kpi_silver):
    plain = kpi.silver_kpi_table(view(spark, sf_dir, "kpi_long"), view(spark, sf_dir, "kpi_wide"), view(spark, sf_dir, "kpi_master"), kpi.YEAR)
    assert Counter(plain.collect()) == Counter(kpi_silver.table.collect())
    long = view(spark, sf_dir, "kpi_long")
    assert kpi_silver.duplicates.count() == 2 * long.count() - long.distinct().count()
    log = kpi_silver.changes.groupBy("LOG_TYPE").count().collect()
    assert {r["LOG_TYPE"] for r in log} == {"OCR_FIX", "NORMALISE"}


def test_no_kpi_row_is_lost_between_sources(spark, kpi_silver, sf_dir):
    """Every delivered cell is either in Silver or in one of the logs of dropped rows; nothing that is no number vanishes."""
    long, wide = view(spark, sf_dir, "kpi_long").distinct(), view(spark, sf_dir, "kpi_wide")
    cells = 12 * long.count() + len(PERIODS) * wide.count()
    unified = kpi.unify(kpi.clean(long, kpi.LONG_SOURCE), kpi.clean(wide, kpi.WIDE_SOURCE), kpi.YEAR)
    assert unified.count() + kpi_silver.dropped.count() == cells
    texts = {r["ORIGINAL_VALUE"] for r in kpi_silver.issues.select("ORIGINAL_VALUE").distinct().collect()}
    assert texts == {"n/a", "1,200"}
    assert kpi_silver.table.filter("IS_VALUE_UNPARSEABLE and actual_value is null").count() > 0


def test_views_hold_all_orders(spark, sf_dir):
    total = table(spark, sf_dir, "orders").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).first()[0]
    wide = unpivot_month_names(view(spark, sf_dir, "kpi_wide")).agg(F.sum(F.col("actual_value").cast("decimal(18,2)"))).first()[0]
    left_out = run_sql(spark, sf_dir, "SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_nationkey % 11 = 10")
    out = left_out.agg(F.sum("p")).first()[0] or 0
    added = view(spark, sf_dir, "kpi_wide").count() * len(PERIODS)
    assert 0 <= wide - (total - out) <= added
    lines = table(spark, sf_dir, "lineitem").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).first()[0]
    cells = unpivot_dates(view(spark, sf_dir, "fin_wide")).withColumn("amount", F.translate("amount", "O", "0").cast("decimal(18,2)"))
    assert cells.agg(F.sum("amount")).first()[0] == lines


def test_gold_is_built_behind_the_gate(spark, sf_dir, tmp_path, kpi_silver):
    from tallyloom.operators.quality import QualityGateError

    cleaned = financial.clean(financial.combine(view(spark, sf_dir, "fin_dirty"), view(spark, sf_dir, "fin_wide")))
    costs = staged(
        financial.conform(cleaned, view(spark, sf_dir, "erp_orders"), view(spark, sf_dir, "fx_rates"), ["line_seq", "amount_raw"], RUN_TS)
        .select(*financial.SILVER_COLUMNS), "silver")
    kpis = staged(kpi_silver.table, "silver-kpi")
    master = view(spark, sf_dir, "kpi_master")
    fact = staged(fact_kpi_actual(kpis, [kpi.LONG_SOURCE, kpi.WIDE_SOURCE]), "fact")
    path = str(tmp_path / "gold")
    names = gold.build_gold(costs, kpis, fact, master, PERIODS[0], PERIODS[-1], path)
    totals = {n: spark.read.parquet(f"{path}/{n}").count() for n in names}
    lines = spark.read.parquet(f"{path}/gold_order_cost").agg(F.sum("cost_lines"), F.sum("unconverted_lines")).first()
    kept = costs.filter("not IS_ORPHANED_ORDER")
    assert tuple(lines) == (kept.count(), kept.filter("converted_amount_vnd is null").count()) and lines[1] > 0
    assert all(totals.values()) and totals["gold_kpi_achievement"] % 12 == 0
    total = spark.read.parquet(f"{path}/gold_order_cost").agg(F.sum("total_cost_vnd")).first()[0]
    assert total == costs.filter("not IS_ORPHANED_ORDER").agg(F.sum("converted_amount_vnd")).first()[0] > Decimal(0)
    assert spark.read.parquet(f"{path}/dq_log").filter("result = 'FAILED'").count() == 0
    with pytest.raises(QualityGateError):
        gold.build_gold(costs.unionByName(costs), kpis, fact, master, PERIODS[0], PERIODS[-1], path)
    assert spark.read.parquet(f"{path}/dq_log").filter("result = 'FAILED'").count() > 0


def test_row_target_can_lead(spark, sf_dir, kpi_silver):
    fact = fact_kpi_actual(kpi_silver.table, [kpi.LONG_SOURCE]).withColumn("row_target", F.lit(7).cast("decimal(18,4)"))
    master = view(spark, sf_dir, "kpi_master")

    def targets(**kw):
        rows = gold.kpi_achievement(fact, master, "2024-05", "2024-06", **kw).filter("not is_missing_actual")
        return {r[0] for r in rows.select("target_value").distinct().collect()}

    assert targets(prefer_row_target=True) == {Decimal(7)}
    assert {Decimal(120000), Decimal(100000)} <= targets()
