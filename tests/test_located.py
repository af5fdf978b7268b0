"""Feeds, late parents, near names, located differences and buckets against plain Python on small fixtures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_plans import plan
from tallyloom.operators import orphans as orphan_tables
from tallyloom.operators.chain import check_chain
from tallyloom.operators.locate import hashed_leaf, locate_differences, range_leaf, rows_that_differ, unequal_leaves, write_digests
from tallyloom.operators.lookup import flag_orphans
from tallyloom.operators.orphans import settle_arrival, settled_facts
from tallyloom.operators.review import near_names, review_candidates
from tallyloom.sources.buckets import flag_orphans_bucketed, merge_bucketed, write_bucketed
from tallyloom.sources.landing import merge_latest


# ---- page chains ------------------------------------------------------------

def findings(spark, rows, start="a"):
    found = check_chain(spark.createDataFrame(rows, "page string, next_page string"), start)
    return {r.page: (r.end_page, r.steps_to_end, r.findings) for r in found.collect()}


def test_a_long_shuffled_chain_is_whole(spark):
    rows = [(f"p{i}", f"p{i + 1}" if i < 400 else None) for i in range(401)]
    random.Random(1).shuffle(rows)
    got = findings(spark, rows, "p0")
    assert {v[2] for v in got.values()} == {""}
    assert all(v[:2] == ("p400", 400 - int(p[1:])) for p, v in got.items())


def test_each_defect_is_named(spark):
    rows = [("a", "b"), ("b", "c"), ("b", "c"), ("c", "gone"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("t", None), ("t", "b"), (None, "q"), ("e", None), ("e", None)]
    assert findings(spark, rows) == {
        "a": ("c", 2, ""), "b": ("c", 1, "REPEATED,SHARED"), "c": ("c", 0, "GAP"),
        "x": (None, None, "LOOP,STRAY"), "y": (None, None, "LOOP,SHARED"), "z": (None, None, "LOOP"), "s": (None, None, "LOOP"),
        "t": ("c", 2, "REPEATED,DISAGREES,STRAY"), "e": ("e", 0, "REPEATED,STRAY"),
    }


def test_a_feed_without_pages(spark):
    assert findings(spark, []) == {}


# ---- orphans ----------------------------------------------------------------

def settle(spark, path, arrival, facts, known, arrived):
    parents = lambda keys: spark.createDataFrame([(k,) for k in keys], "k string")
    settle_arrival(spark, spark.createDataFrame(facts, "k string, v int"), parents(known), parents(arrived), path, "k", arrival)


def settled(spark, path):
    return Counter(map(tuple, settled_facts(spark, path, ["k", "v"]).collect()))


LOADS = [
    ([("a", 1), ("b", 2), ("b", 2), (None, 3), ("c", 4)], ["a"], ["a", "a", None]),
    ([("b", 5), ("c", 6), ("d", 7)], ["a", "b", None], ["b"]),
    ([("c", 8)], ["a", "b", "c"], ["c"]),
]
SETTLED = Counter({
    ("a", 1, "MATCHED", 0, None): 1, ("b", 2, "PROMOTED", 0, 1): 2, (None, 3, "ORPHANED", 0, None): 1, ("c", 4, "PROMOTED", 0, 2): 1,
    ("b", 5, "MATCHED", 1, None): 1, ("c", 6, "PROMOTED", 1, 2): 1, ("d", 7, "ORPHANED", 1, None): 1, ("c", 8, "MATCHED", 2, None): 1,
})


def test_orphans_are_promoted_once_whatever_runs_again(spark, tmp_path):
    path = str(tmp_path / "t")
    for arrival in (0, 1, 1, 2, 2, 0, 1):
        settle(spark, path, arrival, *LOADS[arrival])
    assert settled(spark, path) == SETTLED


@pytest.mark.parametrize("step", ["replace_groups", "write_partitions"])
def test_a_stopped_arrival_is_finished_by_running_it_again(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    for arrival in (0, 1):
        settle(spark, path, arrival, *LOADS[arrival])
    real, calls = getattr(orphan_tables, step), []

    def stop_second(*args, **kwargs):
        calls.append(1)
        if step == "replace_groups" or len(calls) == 2:
            raise RuntimeError("stopped")
        return real(*args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(orphan_tables, step, stop_second)
        with pytest.raises(RuntimeError):
            settle(spark, path, 2, *LOADS[2])
    settle(spark, path, 2, *LOADS[2])
    assert settled(spark, path) == SETTLED


# ---- near names -------------------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def brute_force(names, reference, most):
    pairs = ((a, b) for a in set(names) for b in set(reference) if a and b and a != b)
    close = ((a, b, edit_distance(a, b)) for a, b in pairs)
    return {p for p in close if p[2] <= min(most, min(len(p[0]), len(p[1])) // 4)}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_no_near_name_is_lost(spark, most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("ab é") for _ in range(rng.randint(0, 14)))
    reference = [word() for _ in range(120)] + ["aaaaaaaaaaaa", "aaaaaaaaaaa", "a", "", None]
    names = [word() for _ in range(120)] + ["aaaaaaaaaaaaa", "aaaaaaaaaaaaa", "b" * 5000, "", None]
    got = near_names(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(n,) for n in reference], "r string"), "n", "r", most)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_force(names, reference, most)


def test_the_nearest_candidate_comes_first(spark):
    names = spark.createDataFrame([("acme corp",), ("acme corp",), ("acme corpx",), ("nobody",), (None,), ("",), ("acme co",)], "n string")
    known = spark.createDataFrame([("acme co",), ("acme corps",), ("acme corpz",), (None,)], "r string")
    got = {tuple(r) for r in review_candidates(names, known, "n", "r").collect()}
    # "acme co" is two edits away, but its seven characters allow one.
    assert got == {("acme corp", "acme corps", 1, 2), ("acme corpx", "acme corps", 1, 2), ("nobody", None, None, 0)}


# ---- located differences ----------------------------------------------------

@pytest.mark.parametrize("leaf_of", [lambda: hashed_leaf(["k"], 8), lambda: range_leaf("k", 5)])
def test_located_rows_are_the_signed_difference(spark, tmp_path, leaf_of):
    rng = random.Random(3)
    left = [(rng.choice([None, *range(60)]), rng.choice([None, "x", "y", ""])) for _ in range(300)]
    right = left[20:] + [(None, "x"), (None, None), (7, "new"), (7, "new"), (-3, "y")]
    rng.shuffle(right)
    frames = [spark.createDataFrame(rows, "k int, v string") for rows in (left, right)]
    got = {(r.k, r.v, r.side): r.copies for r in locate_differences(*frames, ["k", "v"], leaf_of(), f"{tmp_path}/l", f"{tmp_path}/r").collect()}
    more, less = Counter(left) - Counter(right), Counter(right) - Counter(left)
    assert got == {**{(*k, "LEFT"): n for k, n in more.items()}, **{(*k, "RIGHT"): n for k, n in less.items()}}


def test_equal_and_empty_sources(spark, tmp_path):
    some = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k int, v string")
    none = some.limit(0)
    leaf = range_leaf("k", 2)
    assert locate_differences(some, some, ["k", "v"], leaf, f"{tmp_path}/a", f"{tmp_path}/b").count() == 0
    assert locate_differences(none, none, ["k", "v"], leaf, f"{tmp_path}/c", f"{tmp_path}/d").count() == 0
    assert locate_differences(some, none, ["k", "v"], leaf, f"{tmp_path}/e", f"{tmp_path}/f").agg(F.sum("copies")).first()[0] == 3


def test_only_unequal_leaves_are_shuffled(spark, tmp_path):
    rows = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    other = rows.withColumn("v", F.when(F.col("k") == 4321, -1).otherwise(F.col("v")).cast("bigint"))
    leaf = range_leaf("k", 100)
    for side, name in ((rows, "l"), (other, "r")):
        write_digests(side, ["k", "v"], leaf, f"{tmp_path}/{name}")
    unequal = unequal_leaves(spark, f"{tmp_path}/l", f"{tmp_path}/r")
    assert [r.leaf for r in unequal.collect()] == [43]
    text = plan(rows_that_differ(rows, other, ["k", "v"], leaf, unequal))
    # Both sides are cut down by a broadcast of leaves below the one shuffle of rows.
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    assert text.index("Exchange hashpartitioning(k#") < text.index("BroadcastHashJoin")


# ---- buckets ----------------------------------------------------------------

@pytest.fixture
def bucketed(spark, tmp_path):
    facts = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 4), ("b", 5)], "order_no string, v int")
    known = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "order_no string")
    names = [f"t{abs(hash(str(tmp_path))) % 10**9}_{n}" for n in ("facts", "known")]
    yield facts, known, names, [write_bucketed(df, n, f"{tmp_path}/{n}", "order_no", 4) for df, n in zip((facts, known), names)]
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_bucketed_join_moves_no_rows(spark, bucketed):
    facts, known, _, tables = bucketed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = flag_orphans_bucketed(*tables)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert sorted(joined.select("v", "IS_ORPHANED_ORDER").collect()) == sorted(flag_orphans(facts, known).select("v", "IS_ORPHANED_ORDER").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_upsert_moves_only_updates(spark, bucketed):
    facts, _, names, tables = bucketed
    updates = spark.createDataFrame([(None, 10), ("b", 11), ("b", 12), ("c", 13)], "order_no string, v int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = merge_bucketed(spark, names[0], updates, "order_no", [F.col("v").desc()])
        text = plan(merged)
        assert text.count("Exchange hashpartitioning") <= 2
        scan = next(i for i, line in enumerate(text.splitlines()) if "FileScan" in line)
        above = text.splitlines()[:scan]
        assert "LeftAnti" in "".join(above) and not any("Exchange" in line for line in above)
        expected = merge_latest(facts, updates, ["order_no"], [F.col("v").desc()])
        assert Counter(map(tuple, merged.select("order_no", "v").collect())) == Counter(map(tuple, expected.select("order_no", "v").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
