"""Tables kept up to date from changes equal those built from all, whatever the order, and after runs that stop half way."""

import os
import pathlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.incremental import apply_deltas, recompute_groups, signed_deltas
from tallyloom.operators.scd import apply_snapshot, build_history
from tallyloom.session import FREE_SHUFFLES, staged, staging
from tallyloom.sources import landing
from tallyloom.sources.landing import Changes, finish_upsert, upsert_batch, upsert_changes, upsert_table
from tallyloom.streaming.arrivals import upsert_new_files

SCHEMA = "k int, v string, seq int, year int, month int"


def newest():
    return [F.col("seq").desc()]


def rows_of(spark, path, *columns):
    return Counter(map(tuple, spark.read.parquet(path).select(*columns).collect()))


# ---- upserts ----------------------------------------------------------------

@pytest.mark.parametrize("step", ["write_partitions", "drop_partitions"])
def test_a_stopped_upsert_is_finished_by_the_next(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    upsert_table(spark, spark.createDataFrame([(1, "a", 1, 2024, 1), (2, "b", 1, 2024, 2)], SCHEMA), path, ["k"], newest())
    moved = spark.createDataFrame([(1, "A", 2, 2024, 3)], SCHEMA)

    def stop(*_args, **_kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(landing, step, stop)
        with pytest.raises(RuntimeError):
            upsert_table(spark, moved, path, ["k"], newest())
    assert finish_upsert(spark, path) and not finish_upsert(spark, path)
    assert rows_of(spark, path, "k", "v", "year", "month") == Counter([(1, "A", 2024, 3), (2, "b", 2024, 2)])
    upsert_table(spark, spark.createDataFrame([(3, "c", 1, 2024, 3)], SCHEMA), path, ["k"], newest())
    assert rows_of(spark, path, "k", "v") == Counter([(1, "A"), (2, "b"), (3, "c")])


def test_an_upsert_stopped_before_its_result_is_there_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_table(spark, spark.createDataFrame([(1, "a", 1, 2024, 1)], SCHEMA), path, ["k"], newest())
    spark.createDataFrame([(1, "half", 9, 2024, 1)], SCHEMA).write.parquet(f"{path}/{landing.PENDING}/merged")
    assert not finish_upsert(spark, path)
    assert rows_of(spark, path, "k", "v") == Counter([(1, "a")]) and not os.path.exists(f"{path}/{landing.PENDING}")


def test_changes_are_the_rows_replaced_and_written(spark, tmp_path):
    path = str(tmp_path / "t")
    first = upsert_changes(spark, spark.createDataFrame([(1, "a", 1, 2024, 1), (2, "b", 1, 2024, 2)], SCHEMA), path, ["k"], newest())
    assert first.before.count() == 0 and first.after.count() == 2
    second = upsert_changes(spark, spark.createDataFrame([(1, "A", 2, 2024, 3), (1, "old", 1, 2024, 1), (None, "n", 1, None, None)], SCHEMA), path, ["k"], newest())
    assert [tuple(r) for r in second.before.select("k", "v").collect()] == [(1, "a")]
    assert Counter(map(tuple, second.after.select("k", "v").collect())) == Counter([(1, "A"), (None, "n")])


def test_batches_run_again_in_any_order(spark, tmp_path):
    path = str(tmp_path / "t")
    loads = [[(1, "a", 1, 2024, 1), (2, "b", 1, 2024, 1)], [(1, "A", 1, 2024, 2), (3, "c", 1, 2024, 2)], [(2, "B", 1, 2024, 1)]]
    for number in (0, 1, 0, 2, 1, 2, 0):
        upsert_batch(spark, spark.createDataFrame(loads[number], SCHEMA), path, ["k"], newest(), number)
    assert rows_of(spark, path, "k", "v", "load_batch") == Counter([(1, "A", 1), (2, "B", 2), (3, "c", 1)])


def test_stream_upserts_each_file_once(spark, tmp_path):
    landed, path, seen = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "seen")
    for rows in ([(1, "a", 1, 2024, 1), (1, "b", 2, 2024, 1)], [(1, "c", 1, 2024, 2)], []):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(landed)
        upsert_new_files(spark, landed, SCHEMA, path, seen, ["k"], newest(), prepare=lambda r: r.withColumn("v", F.upper("v")))
    assert rows_of(spark, path, "k", "v", "month", "load_batch") == Counter([(1, "C", 2, 1)])


# ---- history ------------------------------------------------------------------

HISTORY = {"key": "k", "at": "at", "tracked": ["state"], "overwrite": ["name"], "tiebreak": ["seq"], "unit": "state"}
STATES = "k int, at timestamp, state string, name string, seq int"


def test_history_from_snapshots_equals_the_full_rebuild_after_each(spark, tmp_path):
    rng = random.Random(11)
    path, seen = str(tmp_path / "h"), []
    for number in range(4):
        hours = rng.sample(range(40), 6)
        rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), hour, rng.choice("xyz"), rng.choice(["n", "m"]), 100 * number + i) for i, hour in enumerate(hours)]
        snapshot = spark.createDataFrame(rows, "k int, hour int, state string, name string, seq int").selectExpr("k", "timestamp'2024-01-01' + make_interval(0,0,0,0,hour) AS at", "state", "name", "seq")
        seen += [tuple(r) for r in snapshot.collect()]
        for _ in range(1 + number % 2):
            apply_snapshot(spark, snapshot, path, **HISTORY, buckets=4)
        full = build_history(spark.createDataFrame(seen, STATES), **HISTORY)
        assert rows_of(spark, f"{path}/history", *full.columns) == Counter(map(tuple, full.collect()))


def test_a_snapshot_leaves_the_chains_of_other_keys(spark, tmp_path):
    path = str(tmp_path / "h")
    at = lambda text: f"timestamp'{text}'"
    frame = lambda rows: spark.sql(" UNION ALL ".join(f"SELECT {k} AS k, {at(t)} AS at, '{s}' AS state, 'n' AS name, {q} AS seq" for k, t, s, q in rows))
    apply_snapshot(spark, frame([(k, "2024-01-01", "x", k) for k in range(1, 30)]), path, **HISTORY)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(f"{path}/history") for f in names if f.endswith(".parquet")}
    before = files()
    # Of two rows only one says something new; a third state is late and splits the version between two observations.
    apply_snapshot(spark, frame([(7, "2024-03-01", "y", 40), (8, "2024-03-01", "x", 41)]), path, **HISTORY)
    assert len(before - files()) == 1
    apply_snapshot(spark, frame([(8, "2024-02-01", "z", 42)]), path, **HISTORY)
    chain = spark.read.parquet(f"{path}/history").filter("k = 8").orderBy("Valid_From").selectExpr("state", "string(date(Valid_From))", "is_current").collect()
    assert [tuple(r) for r in chain] == [("x", "2024-01-01", False), ("z", "2024-02-01", False), ("x", "2024-03-01", True)]


# ---- aggregates -----------------------------------------------------------------

def test_deltas_give_the_same_sums_as_all_rows(spark, tmp_path):
    rng = random.Random(3)
    path, mart = str(tmp_path / "s"), str(tmp_path / "m")
    schema = "k int, g string, amount int, year int, month int"
    key, sums = ["g", "year", "month"], {"total": "bigint", "n": "bigint"}
    for _ in range(4):
        rows = [(k, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), 2024, rng.choice([1, 2, None])) for k in rng.sample(range(12), 7)]
        changes = upsert_changes(spark, spark.createDataFrame(rows, schema), path, ["k"], [F.lit(1)])
        deltas = signed_deltas(changes, key, {"total": F.coalesce("amount", F.lit(0)), "n": F.lit(1)})
        apply_deltas(spark, deltas, mart, key, sums, rows="n")
        wanted = spark.read.parquet(path).groupBy(*key).agg(F.sum(F.coalesce("amount", F.lit(0))), F.count("*")).collect()
        assert rows_of(spark, mart, *key, "total", "n") == Counter(map(tuple, wanted))


def test_groups_without_an_inverse_are_built_anew(spark, tmp_path):
    path, mart = str(tmp_path / "s"), str(tmp_path / "m")
    schema = "k int, g string, amount int, year int, month int"
    build = lambda rows: rows.groupBy("g", "year", "month").agg(F.max("amount").alias("top"))
    for rows in ([(1, "a", 5, 2024, 1), (2, "a", 3, 2024, 1), (3, "b", 9, 2024, 2)], [(1, "b", 1, 2024, 2)], [(2, "c", 4, 2024, 3), (3, "b", 0, 2024, 2)]):
        changes = upsert_changes(spark, spark.createDataFrame(rows, schema), path, ["k"], [F.lit(1)])
        recompute_groups(spark, changes, spark.read.parquet(path), mart, ["g"], build)
        assert rows_of(spark, mart, "g", "year", "month", "top") == Counter(map(tuple, build(spark.read.parquet(path)).collect()))
    assert rows_of(spark, mart, "g", "top") == Counter([("b", 1), ("c", 4)])


def test_gold_reads_touched_partitions_only(spark, tmp_path):
    mart = str(tmp_path / "m")
    key, sums = ["g", "year", "month"], {"n": "bigint"}
    schema = "g string, n bigint, year int, month int"
    nothing = spark.createDataFrame([], schema)
    first = spark.createDataFrame([(g, 1, 2024, m) for g in "ab" for m in range(1, 13)], schema)
    apply_deltas(spark, signed_deltas(Changes(nothing, first), key, {"n": F.col("n")}), mart, key, sums, rows="n")
    stamp = lambda: {(d, f) for d, _, names in os.walk(mart) for f in names if f.endswith(".parquet")}
    before = stamp()
    apply_deltas(spark, signed_deltas(Changes(nothing, first.filter("g = 'a' and month = 5")), key, {"n": F.col("n")}), mart, key, sums, rows="n")
    assert {d for d, _ in before ^ stamp()} == {f"{mart}/year=2024/month=5"}


# ---- disk -------------------------------------------------------------------

def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    held, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES)
    counted = spark.range(1000).groupBy((F.col("id") % 12).alias("month")).count().withColumn("year", F.lit(2024))
    table = staged(counted, "counted")
    with staging(spark) as stage:
        stage(counted, "counted")
    landing.write_partitions(table, str(tmp_path / "t"))
    left = None
    for _ in range(50):  # files are removed a moment later
        left = {f for f in shuffle_files(spark) - held if not f.endswith(".tmp")}
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(FREE_SHUFFLES) == setting
    assert counted.count() == counted.count() == table.count() == 12


def test_changes_go_with_their_owner(spark, tmp_path):
    path = str(tmp_path / "t")
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    kept = set(shared.glob("tallyloom-upsert-*"))
    loads = ([(1, "a", 1, 2024, 1), (None, "b", 1, 2024, 2), (3, "c", 1, None, None)], [(1, "A", 2, 2024, 3), (None, "B", 2, 2024, 2), (4, "d", 1, 2024, 3)])
    seen = []
    for load in loads:
        with staging(spark) as stage:
            changes = upsert_changes(spark, spark.createDataFrame(load, SCHEMA), path, ["k"], newest(), stage=stage)
            seen.append([Counter(tuple(r) for r in side.select("k", "v", "year", "month").collect()) for side in (changes.before, changes.after)])
    assert seen[0] == [Counter(), Counter([(1, "a", 2024, 1), (None, "b", 2024, 2), (3, "c", None, None)])]
    assert seen[1] == [Counter([(1, "a", 2024, 1), (None, "b", 2024, 2)]), Counter([(1, "A", 2024, 3), (None, "B", 2024, 2), (4, "d", 2024, 3)])]
    assert rows_of(spark, path, "k", "v") == Counter([(1, "A"), (None, "B"), (3, "c"), (4, "d")])
    assert set(shared.glob("tallyloom-upsert-*")) == kept
