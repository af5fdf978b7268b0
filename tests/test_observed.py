"""Counters taken on the write, the as-of join on one line, and units that come back."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.operators.aggregate import aggregate_kpis, with_stretches
from tallyloom.operators.lookup import as_of, point_in_time
from tallyloom.operators.quality import Expectations, quality_log, write_observed

EXPECT = Expectations("t", ("k",), ("k", "v", "gone"), {"v": "bad"}, "orphan", ("u", "v"))


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_the_write_counts_what_the_checks_count(spark, tmp_path):
    data = [(1, "1.5", False, True, "%"), (1, "x", True, False, "%"), (2, "y", False, False, "N"), (None, None, None, None, None)]
    df = spark.createDataFrame(data, "k int, v string, bad boolean, orphan boolean, u string")
    done = write_observed(df, str(tmp_path / "a"), EXPECT, {"orphans": F.count_if("orphan")})
    assert rows(done.log) == rows(quality_log(df, EXPECT)) and done.counts == {"orphans": 1} and rows(done.table) == rows(df)
    empty = write_observed(df.limit(0), str(tmp_path / "b"), EXPECT)
    assert rows(empty.log) == rows(quality_log(df.limit(0), EXPECT))
    sure = write_observed(df, str(tmp_path / "c"), EXPECT, unique=True)
    assert {r.check_name: r.details for r in sure.log.collect()}["no_duplicates"] == "rows in repeated keys: 0"


def test_the_log_of_a_unique_table_scans_nothing(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS k", "string(id) AS v", "false AS bad", "false AS orphan", "'N' AS u")
    log = write_observed(df, str(tmp_path / "a"), EXPECT, unique=True).log
    assert "FileScan" not in log._jdf.queryExecution().toString()
    keys = write_observed(df, str(tmp_path / "b"), EXPECT).log
    assert "ReadSchema: struct<k:bigint>" in keys._jdf.queryExecution().toString()


def test_as_of_meets_one_version_per_fact(spark):
    rng = random.Random(5)
    starts = {k: sorted(rng.sample(range(300), 40)) for k in range(5)}
    versions = [(k, f, f + 3 if n % 7 == 0 else (list(s)[n + 1] if n + 1 < len(s) else 9999), f"v{f}") for k, s in starts.items() for n, f in enumerate(s)]
    versions = [(k, f, min(t, *[x for x in [*starts[k], 9999] if x > f]), n) for k, f, t, n in versions]
    # Half of all facts lie on one key.
    facts = [(i, 0 if i % 2 else rng.randrange(6), rng.choice([None, *range(-5, 320)])) for i in range(2000)] + [(5000, None, 7)]
    left = spark.createDataFrame(facts, "Valid_To int, key int, at int").withColumnRenamed("Valid_To", "fact")
    right = spark.createDataFrame(versions, "key int, Valid_From int, Valid_To int, name string")
    found = as_of(left, right, "key", "at", lambda c: F.floor(c / 25))
    assert found.columns == ["fact", "key", "at", "Valid_From", "Valid_To", "name"]
    assert rows(found) == rows(point_in_time(left, right, "key", "at"))
    assert rows(as_of(left, right.limit(0), "key", "at", lambda c: F.floor(c / 25)).select("fact", "name")) == Counter((f, None) for f, *_ in facts)
    plan = found._jdf.queryExecution().toString()
    assert "_at >= " not in plan and "SortMergeJoin [_key" in plan or "BroadcastHashJoin [_key" in plan


def test_a_unit_that_returns_starts_a_new_stretch(spark):
    months = [("2024-01", "%"), ("2024-02", "%"), ("2024-03", "N"), ("2024-04", "N"), ("2024-05", "%"), ("2024-07", "%")]
    data = [(1, "2024", p, u, "SUM", 1.0) for p, u in months]
    # Months that have both units are no barrier, and neither is a month without any.
    data += [(2, "2024", p, u, "SUM", 1.0) for p in ("2024-01", "2024-02", "2024-05") for u in ("%", "N")]
    df = spark.createDataFrame(data, "UA_ID int, year string, PERIOD string, Unit string, Aggregation_Method string, value double")
    df = df.withColumn("actual_value", F.col("value").cast("decimal(18,4)")).drop("value")
    marked = with_stretches(df, ["UA_ID"], "Unit", "PERIOD")
    assert {(r.PERIOD, r.unit_stretch) for r in marked.collect() if r.UA_ID == 1} == {("2024-01", 0), ("2024-02", 0), ("2024-03", 0), ("2024-04", 0), ("2024-05", 1), ("2024-07", 1)}
    assert {r.unit_stretch for r in marked.collect() if r.UA_ID == 2} == {0}
    summed = aggregate_kpis(marked, ["UA_ID", "year", "Unit", "unit_stretch"])
    assert Counter((r.Unit, int(r.aggregated_value)) for r in summed.collect() if r.UA_ID == 1) == Counter([("%", 2), ("%", 2), ("N", 2)])
