"""Operators against brute force, hot keys and copies included."""

import random
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators.aggregate import aggregate_kpis, month_spine, year_to_date
from tallyloom.operators.audit import Change, change_log
from tallyloom.operators.dedup import dedup_summary, flag_not_highest, flag_repeats, keep_first_equal, keep_highest
from tallyloom.operators.dims import code_dim, dim_currency, lookup_key
from tallyloom.operators.lookup import (
    asof_rates, canonical_customers, convert_amounts, customer_mapping, flag_orphans, latest_rates, match_master,
    quarantine_orphans, with_base_rate,
)
from tallyloom.operators.orders import nest_lines
from tallyloom.operators.quality import Expectations, QualityGateError, quality_gate, quality_log, require_gate
from tallyloom.operators.reconcile import key_differences, reconcile_sources, source_diff
from tallyloom.operators.reshape import map_fields, union_sources, unpivot_dates
from tallyloom.operators.scd import build_history
from tallyloom.operators.spread import with_next, with_previous


def hot_rows(n=600, seed=7):
    """A third of the rows on one key, many copies of one row among them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append(("HOT", "c", "2024-01", Decimal(rng.randint(1, 5)), i))
        else:
            amount = None if i % 17 == 0 else Decimal(rng.randint(1, 9))
            rows.append((rng.choice([f"k{j}" for j in range(40)] + [None]), rng.choice("ab"), "2024-01", amount, i))
    return rows


ROW = "order_no string, category string, period string, amount decimal(18,4), seq int"
KEY = ["order_no", "category", "period"]


def test_keep_highest_and_its_log(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, ROW).repartition(5)
    best = {}
    for r in rows:
        rank = (r[3] is None, -(r[3] or 0), r[4])
        if r[:3] not in best or rank < best[r[:3]][0]:
            best[r[:3]] = (rank, r[4])
    winners = {v[1] for v in best.values()}
    kept = {r["seq"] for r in keep_highest(df, KEY, "amount", ["seq"]).collect()}
    flagged = flag_not_highest(df, KEY, "amount", ["seq"]).collect()
    assert kept == winners
    assert len(flagged) == len(rows)
    assert {r["seq"] for r in flagged if not r["IS_DUPLICATE"]} == winners


def test_copies_without_a_sequence(spark):
    rows = [r[:4] for r in hot_rows()] + [("HOT", "c", "2024-01", Decimal(9))] * 250
    df = spark.createDataFrame(rows, "order_no string, category string, period string, amount decimal(18,4)").repartition(4)
    flagged = flag_not_highest(df, KEY, "amount", None)
    assert Counter(tuple(r)[:4] for r in flagged.collect()) == Counter(rows)
    kept = Counter(tuple(r)[:4] for r in flagged.filter("not IS_DUPLICATE").collect())
    best = {}
    for r in rows:
        if r[:3] not in best or (r[3] or 0) > (best[r[:3]] or 0):
            best[r[:3]] = r[3]
    assert kept == Counter((*k, v) for k, v in best.items())
    repeats = flag_repeats(df, KEY, None)
    assert repeats.filter("not IS_DUPLICATE").count() == len(best)
    assert repeats.count() == len(rows)


def test_keep_highest_twice_changes_nothing(spark):
    once = keep_highest(spark.createDataFrame(hot_rows(), ROW), KEY, "amount", ["seq"])
    twice = keep_highest(once, KEY, "amount", ["seq"])
    assert Counter(once.collect()) == Counter(twice.collect())


def test_first_of_equal_rows(spark):
    rows = [(None, "x", 3), ("", "x", 1), ("a", "x", 2), ("a", "x", 5), *[("hot", "h", 10 + i) for i in range(300)]]
    df = spark.createDataFrame(rows, "k string, v string, seq int").withColumn("SOURCE_FILE", F.lit("f")).repartition(4)
    assert {r["seq"] for r in keep_first_equal(df, ["k", "v"], ["seq"]).collect()} == {1, 2, 10}
    flagged = flag_repeats(df, ["k", "v"], ["seq"])
    assert {r["seq"] for r in flagged.filter("not IS_DUPLICATE").collect()} == {1, 2, 10}
    total = dedup_summary(flagged).first()
    assert (total["DROPPED_COUNT"], total["KEPT_COUNT"]) == (len(rows) - 3, 3)


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_equal_a_plain_window(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if i % 3 else rng.choice("abc"), t, rng.randint(0, 9)) for i, t in enumerate(rng.sample(range(2000), 400))]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    plain = Window.partitionBy("k").orderBy("t")
    expected = df.withColumns({"p": F.lag("v").over(plain), "n": F.lead("t").over(plain)})
    bucket = F.floor(F.col("t") / 50)
    got = with_next(with_previous(df, ["k"], ["t"], bucket, {"p": "v"}), ["k"], ["t"], bucket, {"n": "t"})
    assert Counter(got.select(*expected.columns).collect()) == Counter(expected.collect())


def test_reconcile_settles_each_key(spark):
    rng = random.Random(3)
    columns = "k string, Sub_Pillar string, Sub_KPI_Type string, actual_value decimal(18,4), src string"
    sides = []
    for src in ("long", "wide"):
        rows = [(f"k{i % 60}", None, " ", rng.choice([None, Decimal(1), Decimal(2)]), src) for i in range(150)]
        rows += [("hot", "s", "t", Decimal(rng.randint(0, 80)), src) for _ in range(100)]
        sides.append(rows)
    values = defaultdict(dict)
    for rows in sides:
        for k, _, _, v, src in rows:
            values[k].setdefault(v, src)
    expected = set()
    for k, seen in values.items():
        given = {v: s for v, s in seen.items() if v is not None}
        for v, s in (given or seen).items():
            expected.add((k, v, s, len(given) > 1))
    df = reconcile_sources([spark.createDataFrame(s, columns) for s in sides], ["k"], "actual_value")
    got = [tuple(r) for r in df.select("k", "actual_value", "src", "IS_CONFLICT").collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert {r[0] for r in df.filter("k = 'k1'").select("Sub_Pillar").collect()} == {"UNKNOWN"}
    assert {r[0] for r in df.filter("k = 'k1'").select("Sub_KPI_Type").collect()} == {"N/A"}


def test_source_diff_without_pairing(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3), (4, "d", 4), (4, "d", 4)], "k int, f string, m int")
    right = spark.createDataFrame([(1, "a", 1), (2, "B", 2), (None, "n", 3), (5, "e", 9), (4, "d", 4)], "k int, f string, m int")
    keys = {r["k"]: r for r in key_differences(left, right, ["k"], ["f"]).collect()}
    assert keys[2]["f_differs"] and not keys[1]["f_differs"] and not keys[None]["f_differs"]
    assert keys[4]["f_differs"] and keys[5]["left_rows"] == 0
    report = {r["check_name"]: r for r in source_diff(left, right, ["k"], ["f"], ["m"]).collect()}
    assert report["row_count"]["matches"] and not report["only_here"]["matches"]
    assert (report["repeated_keys"]["left_value"], report["repeated_keys"]["right_value"]) == (1, 0)
    assert (report["sum:m"]["left_value"], report["sum:m"]["right_value"]) == (14, 19)


def test_nested_lines(spark):
    headers = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (1, "again")], "order_id int, code string")
    lines = spark.createDataFrame([(7, 1, "x"), (5, 1, "y"), (9, None, "z"), (3, 99, "orphan")], "line_id int, order_id int, note string")
    got = {r["code"]: [i["line_id"] for i in r["line_items"]] for r in nest_lines(headers, lines).collect()}
    assert got == {"a": [5, 7], "b": [], "n": [9], "again": [5, 7]}


def test_every_order_is_cut_by_the_same_rule(spark):
    headers = spark.createDataFrame([(1,), (2,), (3,)], "order_id int")
    rows = [(i, 1, "n") for i in range(95)] + [(12, 1, "copy")] * 3 + [(1, 2, "small"), (25, 2, "late"), (None, 2, "none")]
    lines = spark.createDataFrame(rows, "line_id int, order_id int, note string").repartition(3)
    got = nest_lines(headers, lines, part_lines=10).collect()
    assert Counter((i["line_id"], r["order_id"], i["note"]) for r in got for i in r["line_items"]) == Counter(rows)
    assert sorted((r["order_id"], r["line_part"]) for r in got) == [*((1, p) for p in range(10)), (2, 0), (2, 2), (3, 0)]
    for r in got:
        numbers = [i["line_id"] for i in r["line_items"]]
        assert all(n is None or n // 10 == r["line_part"] for n in numbers)
        assert [n for n in numbers if n is not None] == sorted(n for n in numbers if n is not None)


def test_key_differences_of_repeated_keys(spark):
    from tallyloom.operators.reconcile import key_differences, source_diff

    schema = "k int, a int, b string"
    left = [(1, 1, "x"), (1, 2, "x"), (1, 2, "x"), (1, 3, "x"), (2, 1, "a"), (2, 2, "b"), (3, 5, None), (4, 1, "q"), (None, 1, "n"), (6, 7, "s")]
    right = [(1, 1, "x"), (1, 1, "x"), (1, 3, "x"), (1, 3, "x"), (2, 1, "b"), (2, 2, "a"), (3, 5, ""), (5, 1, "q"), (None, 1, "n"), (6, 7, "s")]
    args = (spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ["a", "b"])
    got = {r["k"]: (r["left_rows"], r["right_rows"], r["a_differs"], r["b_differs"], r["row_differs"]) for r in key_differences(*args).collect()}
    expected = {}
    for k in {r[0] for r in left + right}:
        here, there = [r for r in left if r[0] == k], [r for r in right if r[0] == k]
        both = bool(here and there)
        pick = lambda rows, i: Counter(r[i] for r in rows)
        expected[k] = (
            len(here), len(there), both and pick(here, 1) != pick(there, 1), both and pick(here, 2) != pick(there, 2), both and Counter(here) != Counter(there)
        )
    assert got == expected and expected[1][2] and expected[2] == (2, 2, False, False, True)
    report = {r["check_name"]: r for r in source_diff(*args, ["a"]).collect()}
    assert report["sum:a"]["left_value"] == sum(r[1] for r in left) and report["sum:a"]["right_value"] == sum(r[1] for r in right)
    assert report["differs:row"]["left_value"] == 3 and not report["differs:row"]["matches"]


RATES = [
    ("USD", "24000", "2024-01-20"), ("USD", "24500", "2024-03-31"), ("USD", "24900", "2024-09-01"),
    ("EUR", "26000", "2024-06-15"), ("JPY", "160", "2024-01-01"), ("JPY", "170", "2024-01-31"), ("JPY", "171", "2024-01-31"),
]


def test_asof_rate_is_the_nearest(spark):
    rates = spark.createDataFrame(RATES, "currency_code string, rate_to_vnd string, effective_date string")
    periods = [f"{y}-{m:02d}" for y in (2022, 2023, 2024, 2025, 2026) for m in range(1, 13)] + ["Q1", None]
    rows = [(c, p) for c in ("USD", "EUR", "JPY", "VND", "GBP") for p in periods]
    got = asof_rates(spark.createDataFrame(rows, "currency string, period string"), rates).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["currency"] == "VND":
            expected = Decimal(1)
        elif r["currency"] == "GBP" or not (r["period"] or "").startswith("20"):
            expected = None
        else:
            start = date.fromisoformat(r["period"] + "-01")
            own = [(abs((date.fromisoformat(d) - start).days), d, Decimal(x)) for c, x, d in RATES if c == r["currency"]]
            expected = min(own)[2]
        assert r["rate_to_vnd"] == expected, r


def test_conversion_keeps_rows_and_flags_failures(spark):
    rates = spark.createDataFrame(RATES, "currency_code string, rate_to_vnd string, effective_date string")
    costs = spark.createDataFrame(
        [("USD", Decimal("2")), ("VND", Decimal("5")), ("GBP", Decimal("1")), ("USD", None), (None, Decimal("1"))],
        "currency string, amount_numeric decimal(18,4)",
    )
    got = convert_amounts(costs, latest_rates(with_base_rate(rates))).collect()
    assert Counter((r["currency"], r["converted_amount_vnd"], r["IS_FX_CONVERSION_FAILED"]) for r in got) == Counter([
        ("USD", Decimal("49800"), False), ("VND", Decimal("5"), False), ("GBP", None, True), ("USD", None, True), (None, None, True)])
    assert with_base_rate(with_base_rate(rates)).filter("currency_code = 'VND'").count() == 1
    assert dim_currency(rates).count() == 4


def test_customers(spark):
    names = ["Sunrise Apparel", "SUNRISE  apparel", " sunrise apparel inc.", "Sunrise Garments", "o'neil ltd", None, " "]
    df = spark.createDataFrame([(n,) for n in names], "customer_name string")
    got = canonical_customers(df, customer_mapping(spark)).collect()
    assert Counter(r["customer_name"] for r in got) == Counter({"Sunrise Apparel": 4, "O'Neil Ltd": 1, None: 1, "": 1})
    assert Counter(r["normalization_status"] for r in got) == Counter({"MATCHED": 4, "UNMATCHED": 1, "REVIEW": 2})


def test_orphans_do_not_multiply(spark):
    costs = spark.createDataFrame([("a",), ("b",), (None,)], "order_no string")
    known = spark.createDataFrame([("a",), ("a",), (None,)], "order_no string")
    assert Counter((r[0], r[1]) for r in flag_orphans(costs, known).collect()) == Counter([("a", False), ("b", True), (None, True)])
    assert {r[0] for r in quarantine_orphans(costs, known).collect()} == {"b", None}


def test_master_match(spark):
    keys = "Pillar string, Sub_Pillar string, Department string, KPI_Name string, Sub_KPI_Type string"
    rows = spark.createDataFrame([("P", "S", "D", "K", "N/A", "2024-05"), ("P", "S", "D", "K", "N/A", "2024-06"), ("P", "S", "D", "Old", "N/A", "2024-01")], keys + ", PERIOD string")
    master = spark.createDataFrame(
        [("P", "S", "D", "K", "N/A", 1, "Y", "2024-01", "2024-06", "v1"), ("P", "S", "D", "K", "N/A", 1, "Y", "2024-06", "9999-12", "v2"),
         ("P", "S", "D", "Old", "N/A", 2, "N", "2024-01", "9999-12", "v1")],
        keys + ", UA_ID int, Is_Active string, Valid_From string, Valid_To string, Source_Version string",
    )
    got = {(r["KPI_Name"], r["PERIOD"]): (r["Source_Version"], r["IS_ORPHANED"]) for r in match_master(rows, master, "PERIOD").collect()}
    assert got == {("K", "2024-05"): ("v1", False), ("K", "2024-06"): ("v2", False), ("Old", "2024-01"): (None, True)}


@pytest.mark.parametrize("bucketed", [False, True])
def test_history_is_disjoint_and_compact(spark, bucketed):
    rng = random.Random(11)
    rows = [("hot" if i % 3 == 0 else rng.choice("xyz"), i // 2, i, rng.choice(["a", "b"]), rng.choice(["%", "N"]), f"name{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, id int, target string, unit string, name string")
    bucket = F.floor(F.col("at") / 7) if bucketed else None
    got = build_history(df, "k", "at", ["target", "unit"], ["name"], ["id"], "unit", bucket, F.lit(10**6)).collect()
    expected = []
    for k in ("hot", "x", "y", "z"):
        last_at = {}
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            last_at[r[1]] = r
        chain = []
        for at in sorted(last_at):
            state = last_at[at][3:5]
            if not chain or chain[-1][1] != state:
                chain.append((at, state))
        name = last_at[max(last_at)][5]
        for i, (at, state) in enumerate(chain):
            until = chain[i + 1][0] if i + 1 < len(chain) else 10**6
            expected.append((k, *state, at, until, i + 1 == len(chain), i > 0 and chain[i - 1][1][1] != state[1], name))
    columns = ["k", "target", "unit", "Valid_From", "Valid_To", "is_current", "unit_changed", "name"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(expected)


def test_method_aggregation(spark):
    rows = [(m, f"2024-{i + 1:02d}", v) for m in ("SUM", "AVERAGE", "LAST") for i, v in enumerate([Decimal(100), Decimal(110), Decimal(120), None])]
    df = spark.createDataFrame(rows, "Aggregation_Method string, PERIOD string, actual_value decimal(18,4)").withColumn("k", F.lit(1))
    got = {r["Aggregation_Method"]: r["aggregated_value"] for r in aggregate_kpis(df, ["k"]).collect()}
    assert got == {"SUM": Decimal(330), "AVERAGE": Decimal(110), "LAST": Decimal(120)}
    lower = df.withColumnsRenamed({"Aggregation_Method": "aggregation_method", "PERIOD": "period"})
    ytd = {(r["aggregation_method"], r["period"]): r["ytd_actual"] for r in year_to_date(lower, ["k", "aggregation_method"]).collect()}
    assert [ytd[(m, "2024-02")] for m in ("SUM", "AVERAGE", "LAST")] == [Decimal(210), Decimal(105), Decimal(110)]
    assert len(ytd) == 9


def test_spine_has_each_month_once(spark):
    versions = spark.createDataFrame([(1, "2023-01", "2024-03"), (1, "2024-03", "9999-12"), (2, "2024-11", "9999-12"), (3, "2025-01", "9999-12")], "UA_ID int, Valid_From string, Valid_To string")
    got = Counter((r["UA_ID"], r["PERIOD"]) for r in month_spine(versions, "2024-01", "2024-12").collect())
    assert got == Counter([(1, f"2024-{m:02d}") for m in range(1, 13)] + [(2, "2024-11"), (2, "2024-12")])


def test_change_log_ignores_null_against_empty(spark):
    df = spark.createDataFrame([("r1", None, "", "x", "X"), ("r2", "1O", "10", None, None)], "id string, a string, b string, c string, d string")
    got = change_log(df, ["id"], [Change("A", F.col("a"), F.col("b"), "T1"), Change("C", F.col("c"), F.col("d"), "T2")], "2024-01-01 00:00:00")
    assert {(r["id"], r["COLUMN_NAME"], r["ORIGINAL_VALUE"], r["CORRECTED_VALUE"]) for r in got.collect()} == {("r1", "C", "x", "X"), ("r2", "A", "1O", "10")}


def test_reshape(spark):
    wide = spark.createDataFrame([("a", "1", None), ("b", "2", "3")], ["k", "31/01/2024", "29/02/2024"])
    assert {tuple(r) for r in unpivot_dates(wide).select("k", "period", "amount").collect()} == {("a", "2024-01", "1"), ("b", "2024-01", "2"), ("b", "2024-02", "3")}
    with pytest.raises(ValueError):
        unpivot_dates(wide.select("k"))
    assert map_fields(wide, {"k": "key", "absent": "none"}).columns == ["key", "none"]
    assert union_sources(wide.select("k"), wide).columns == ["k", "31/01/2024", "29/02/2024"]


def test_lookup_key_falls_back_to_unknown(spark):
    dim = code_dim(spark.createDataFrame([("A",), (" A",), ("",), (None,), ("B",)], "c string"), "c", "drop")
    assert dim.count() == 2
    facts = spark.createDataFrame([("A",), ("Z",), (None,)], "c string")
    keys = {r["c"]: r["drop_sk"] for r in lookup_key(facts, dim, "c", "drop_code", "drop_sk").collect()}
    assert keys["A"] > 0 and keys["Z"] == keys[None] == -1


EXPECT = Expectations("t", ("k",), ("k", "v"), {"v": "IS_V"}, "IS_ORPHANED")


def results(df, expect=EXPECT):
    return {r["check_name"]: (r["result"], r["details"]) for r in quality_log(df, expect).collect()}


def test_quality_outcomes(spark):
    schema = "k string, v string, IS_ORPHANED boolean"
    good = spark.createDataFrame([("a", "1", False), ("b", None, False)], schema)
    assert {r for r, _ in results(good).values()} == {"PASSED"}
    bad = spark.createDataFrame([("a", "1O", True), ("a", "x", False), ("a", "1", False), ("b", "2", False)], schema)
    got = results(bad)
    assert got["no_duplicates"] == ("FAILED", "rows in repeated keys: 3")
    assert got["no_ocr_typos"] == ("FAILED", "v: 2")
    flagged = bad.withColumn("IS_V", F.col("v").isin("1O", "x"))
    assert results(flagged)["no_ocr_typos"] == ("WARNING", "v: 2 flagged")
    assert results(flagged.withColumn("IS_V", F.col("v") == "x"))["no_ocr_typos"] == ("FAILED", "v: 1; v: 1 flagged")
    assert got["orphaned_flagged"][0] == "WARNING"
    empty = results(good.filter("false"))
    assert empty["silver_not_empty"][0] == "FAILED" and empty["mandatory_columns"][0] == "FAILED"
    missing = results(good.drop("v", "IS_ORPHANED"))
    assert missing["mandatory_columns"] == ("FAILED", "v is missing")
    assert missing["orphaned_flagged"][0] == "FAILED"


def test_gate(spark):
    warn = spark.createDataFrame([("PASSED",), ("WARNING",)], "result string")
    assert quality_gate(warn).first()["can_proceed"]
    require_gate(warn)
    with pytest.raises(QualityGateError):
        require_gate(spark.createDataFrame([("FAILED",), ("WARNING",)], "result string"))
