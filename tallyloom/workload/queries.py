"""The registered queries: every operator on the given tables, whole."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampType

from tallyloom.functions.amounts import achievement, is_zero_actual_lower, is_zero_target, to_amount
from tallyloom.functions.identity import row_digest
from tallyloom.functions.periods import parse_period
from tallyloom.functions.text import flag, repair_ocr_digits, squeeze
from tallyloom.operators.aggregate import aggregate_kpis, month_spine, with_missing_months, with_stretches
from tallyloom.operators.chain import check_chain
from tallyloom.operators.dedup import (
    first_source_summary, flag_not_highest, flag_repeats, keep_first_equal, keep_highest, repeat_log,
)
from tallyloom.operators.dims import code_dim, customer_spellings, dim_currency, dim_customer, dim_date, month_bounds
from tallyloom.operators.facts import fact_kpi_actual, fact_order_cost
from tallyloom.operators.locate import locate_differences, range_leaf
from tallyloom.operators.lookup import (
    as_of, asof_rates, canonical_customers, convert_amounts, customer_mapping, flag_orphans, latest_rates, match_master,
    point_in_time, quarantine_orphans, with_base_rate,
)
from tallyloom.operators.orders import HEADER_FIELDS, LINE_FIELDS, nest_lines
from tallyloom.operators.orphans import settle_arrival, settled_facts
from tallyloom.operators.quality import achievement_findings, null_counts, quality_gate, quality_log, write_observed
from tallyloom.operators.reconcile import fill_kpi_sentinels, key_differences, reconcile_sources, source_diff
from tallyloom.operators.reshape import (
    map_fields, unpivot_dates, unpivot_month_names, unpivot_month_numbers,
)
from tallyloom.operators.review import review_candidates
from tallyloom.operators.scd import apply_snapshot, build_history
from tallyloom.plans import financial, gold, kpi
from tallyloom.plans.orders import NUMERIC_IDS
from tallyloom.session import scratch_path, staged, staging, tune
from tallyloom.sources.buckets import flag_orphans_bucketed, write_bucketed
from tallyloom.sources.landing import append_bronze, merge_latest, upsert_batch, upsert_changes, upsert_table, with_year_month, write_partitions
from tallyloom.streaming.arrivals import upsert_new_files
from tallyloom.sources.pages import flatten_pages, landed_documents, page_links, quarantine_pages, raw_records, record_fields
from tallyloom.sources.tables import parquet_copy, with_run_time
from tallyloom.workload.views import PERIODS, RUN_TS, YEAR_SHIFT, run_sql, table, view

TIEBREAK = ["line_seq", "SOURCE_FILE", "currency", "amount_raw"]
FIRST_MONTH, LAST_MONTH = PERIODS[0], PERIODS[-1]
# a few months before and after the delivered ones
SPINE = ("2022-07", "2030-02")
PAGE_SIZE = 500

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps as text, the forms both engines print alike."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(name: str):
    """Register a query under its key."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(tune(spark), sf_dir.rstrip("/")))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- shared inputs -------------------------------------------------------

def _order_headers(spark, d):
    return run_sql(
        spark, d,
        """SELECT o_orderkey AS id, o_custkey AS userId, concat('ORD-', CAST(o_orderkey AS STRING)) AS title,
                  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS body FROM {orders}""",
    )


def _order_lines(spark, d):
    return run_sql(
        spark, d,
        """SELECT CAST(l_linenumber AS BIGINT) AS id, l_orderkey AS postId, concat('PART-', CAST(l_partkey AS STRING)) AS name,
                  concat('supplier-', CAST(l_suppkey AS STRING), '@example.com') AS email,
                  concat(CAST(l_quantity AS STRING), ' x ', CAST(l_shipdate AS STRING)) AS body FROM {lineitem}""",
    )


def _order_pages(spark, d):
    """Order headers as landed documents of at most PAGE_SIZE keys, lists and envelopes, with broken documents beside some pages."""
    records = _order_headers(spark, d).withColumn("page", F.floor(F.col("id") / PAGE_SIZE))
    pages = records.groupBy("page").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("id", "userId", "title", "body")))).alias("_list")
    )
    kind, number = F.col("page") % 7, F.col("page").cast("string")
    whole = F.when(kind == 0, F.concat(F.lit('{"data":'), F.col("_list"), F.lit(',"next_page":"c'), number, F.lit('"}'))).otherwise(F.col("_list"))
    broken = (
        F.when(kind == 1, F.lit('{"data":null,"next_page":null}'))
        .when(kind == 2, F.expr("substr(_list, 1, length(_list) - 5)"))
        .when(kind == 3, F.lit("  "))
        .when(kind == 4, F.concat(F.lit('{"data":{"page":'), number, F.lit("}}")))
    )
    documents = F.array_compact(F.array(F.struct(number.alias("page"), whole.alias("document")), F.when(broken.isNotNull(), F.struct(F.concat(number, F.lit("-again")).alias("page"), broken.alias("document")))))
    return pages.select(F.inline(documents))


def _line_pages(spark, d):
    """Order lines as landed documents, one for each block of order keys."""
    records = _order_lines(spark, d).withColumn("page", F.floor(F.col("postId") / PAGE_SIZE))
    pages = records.groupBy("page").agg(F.collect_list(F.struct("id", "postId", "name", "email", "body")).alias("_list"))
    return pages.select(F.col("page").cast("string").alias("page"), F.concat(F.lit('{"data":'), F.to_json("_list"), F.lit("}")).alias("document"))


def _cleaned(spark, d):
    return financial.clean(financial.combine(view(spark, d, "fin_dirty"), view(spark, d, "fin_wide")))


def _cleaned_long(spark, d):
    return financial.clean(view(spark, d, "fin_dirty").withColumn("SOURCE_FILE", F.lit(financial.LONG_SOURCE)))


def _silver_financial(spark, d):
    return financial.conform(_cleaned(spark, d), view(spark, d, "erp_orders"), view(spark, d, "fx_rates"), TIEBREAK, RUN_TS)


def _kpi_long(spark, d):
    return kpi.clean(view(spark, d, "kpi_long"), kpi.LONG_SOURCE)


def _kpi_wide(spark, d):
    return kpi.clean(view(spark, d, "kpi_wide"), kpi.WIDE_SOURCE)


def _master(spark, d):
    return fill_kpi_sentinels(view(spark, d, "kpi_master"))


def _silver_kpi(spark, d):
    return kpi.silver_kpi_table(view(spark, d, "kpi_long"), view(spark, d, "kpi_wide"), view(spark, d, "kpi_master"), kpi.YEAR)


def _fact_kpi(spark, d):
    return fact_kpi_actual(_silver_kpi(spark, d), [kpi.LONG_SOURCE, kpi.WIDE_SOURCE])


def _kpi_months(spark, d):
    return gold.kpi_achievement(_fact_kpi(spark, d), view(spark, d, "kpi_master"), FIRST_MONTH, LAST_MONTH)


# ---- sources and sinks ---------------------------------------------------

@query("src_csv_roundtrip")
def q_src_csv_roundtrip(spark, d):
    raw = run_sql(
        spark, d,
        """SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, o_orderstatus,
                  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS o_totalprice,
                  date_format(o_orderdate, 'dd/MM/yyyy') AS o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority
           FROM {orders}""",
    )
    landed = scratch_path(spark, "orders-csv")
    raw.write.option("header", True).csv(landed)
    return parquet_copy(spark, landed, scratch_path(spark, "orders-parquet"))


@query("json_pages_flatten")
def q_json_pages_flatten(spark, d):
    fields = {name: (source, "bigint" if source in NUMERIC_IDS else "string") for source, name in HEADER_FIELDS.items()}
    return record_fields(flatten_pages(_order_pages(spark, d)), fields)


@query("json_quarantine")
def q_json_quarantine(spark, d):
    return quarantine_pages(_order_pages(spark, d), "GET /orders/headers", RUN_TS)


@query("page_chain")
def q_page_chain(spark, d):
    """A feed of small order pages, each naming the next: some never land, some land twice or disagree, some point back."""
    pages = run_sql(
        spark, d,
        """SELECT n, concat('p', CAST(n AS STRING)) AS page, data, CASE WHEN n % 19 = 7 THEN n - 3 WHEN n < last THEN n + 1 END AS next_no
           FROM (SELECT o_orderkey DIV 10 AS n, (SELECT max(o_orderkey) DIV 10 FROM {orders}) AS last, to_json(collect_list(o_orderkey)) AS data
                 FROM {orders} GROUP BY o_orderkey DIV 10) WHERE n % 13 <> 5""",
    )
    whole = F.concat(F.lit('{"data":'), "data", F.lit(',"next_page":'), F.coalesce(F.concat(F.lit('"p'), F.col("next_no").cast("string"), F.lit('"')), F.lit("null")), F.lit("}"))
    again = F.array_compact(F.array(whole, F.when(F.col("n") % 17 == 3, whole), F.when(F.col("n") % 23 == 9, F.col("data"))))
    return check_chain(page_links(pages.select("page", F.explode(again).alias("document"))), "p0")


@query("bronze_metadata")
def q_bronze_metadata(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("_metadata.file_name").alias("SOURCE_FILE"))
    return with_run_time(orders, RUN_TS)


@query("bronze_append")
def q_bronze_append(spark, d):
    """Two arrivals, old orders then new ones; both stay."""
    path = scratch_path(spark, "bronze-orders")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    old = F.coalesce(F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01'"), F.lit(True))
    append_bronze(orders.filter(old).drop("o_orderdate"), path, "2024-01-31 06:00:00")
    append_bronze(orders.filter(~old).drop("o_orderdate"), path, "2024-02-07 06:00:00")
    return spark.read.parquet(path).withColumn("ingestion_date", F.col("ingestion_date").cast("string"))


@query("upsert_latest")
def q_upsert_latest(spark, d):
    """Orders updated from a shifted copy that holds two versions per key, and new keys."""
    target = run_sql(spark, d, "SELECT o_orderkey AS order_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,4)) AS total FROM {orders}")
    updates = run_sql(
        spark, d,
        """SELECT o_orderkey + 1000 AS order_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,4)) AS total, 1 AS seq
           FROM {orders} WHERE o_orderstatus <> 'F'
           UNION ALL
           SELECT o_orderkey + 1000, 'U', CAST(o_totalprice AS DECIMAL(18,4)) + 1, 2 FROM {orders} WHERE o_orderstatus = 'P'""",
    )
    return merge_latest(target, updates, ["order_id"], [F.col("seq").desc()])


@query("upsert_table")
def q_upsert_table(spark, d):
    """Orders kept by month; a second load moves some to the next month, changes others and adds new ones."""
    path = scratch_path(spark, "orders-by-month")
    first = run_sql(
        spark, d,
        """SELECT o_orderkey AS order_id, o_orderstatus AS status, 1 AS seq, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month
           FROM {orders} WHERE o_orderkey % 10 <> 9""",
    )
    second = run_sql(
        spark, d,
        """SELECT o_orderkey AS order_id, 'M' AS status, 2 AS seq, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) % 12 + 1 AS INT) AS month
           FROM {orders} WHERE o_orderkey % 10 = 3
           UNION ALL
           SELECT o_orderkey, 'X', 1, CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT) FROM {orders} WHERE o_orderkey % 10 IN (3, 4, 9)""",
    )
    for load in (first, second, second):
        upsert_table(spark, load, path, ["order_id"], [F.col("seq").desc()])
    return spark.read.parquet(path).drop("seq")


@query("upsert_arrivals")
def q_upsert_arrivals(spark, d):
    """Orders landed as files in three arrivals, taken by a bounded stream; the last batch is taken twice."""
    landing, path, seen = (scratch_path(spark, f"arrivals-{n}") for n in ("landing", "orders", "checkpoint"))
    columns = "CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month"
    loads = (
        f"SELECT o_orderkey AS order_id, o_orderstatus AS status, 1 AS seq, {columns} FROM {{orders}} WHERE o_orderkey % 4 <> 3",
        f"SELECT o_orderkey AS order_id, 'S' AS status, 2 AS seq, {columns} FROM {{orders}} WHERE o_orderkey % 4 >= 2 "
        f"UNION ALL SELECT o_orderkey, 'old', 1, {columns} FROM {{orders}} WHERE o_orderkey % 4 = 2",
        "SELECT o_orderkey AS order_id, 'T' AS status, 1 AS seq, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) % 12 + 1 AS INT) AS month FROM {orders} WHERE o_orderkey % 4 = 0",
    )
    newest = [F.col("seq").desc()]
    for number, text in enumerate(loads):
        load = run_sql(spark, d, text)
        load.write.mode("append").parquet(landing)
        upsert_new_files(spark, landing, load.schema, path, seen, ["order_id"], newest, fmt="parquet")
        if number:
            # A batch that runs again, here one that is no longer the last, changes nothing.
            upsert_batch(spark, run_sql(spark, d, loads[number - 1]), path, ["order_id"], newest, number - 1)
    return spark.read.parquet(path).drop("seq")


@query("gold_partition_rebuild")
def q_gold_partition_rebuild(spark, d):
    """Monthly order totals; the months of 1997 are rebuilt, the rest is left as written."""
    path = scratch_path(spark, "gold-orders")
    monthly = with_year_month(
        run_sql(
            spark, d,
            """SELECT o_orderstatus, date_format(o_orderdate, 'yyyy-MM') AS period, CAST(o_totalprice AS DECIMAL(18,4)) AS total FROM {orders}""",
        ).groupBy("o_orderstatus", "period").agg(F.sum("total").cast("decimal(28,4)").alias("total")),
        "period",
    )
    write_partitions(monthly, path)
    write_partitions(monthly.filter("year = 1997").withColumn("total", (F.col("total") * 2).cast("decimal(28,4)")), path)
    return spark.read.parquet(path)


# ---- projections and reshaping -------------------------------------------

@query("map_order_fields")
def q_map_order_fields(spark, d):
    return map_fields(_order_headers(spark, d).drop("body"), HEADER_FIELDS)


@query("map_line_fields")
def q_map_line_fields(spark, d):
    return map_fields(_order_lines(spark, d), LINE_FIELDS)


@query("unpivot_dates")
def q_unpivot_dates(spark, d):
    return unpivot_dates(view(spark, d, "fin_wide"))


@query("unpivot_month_names")
def q_unpivot_month_names(spark, d):
    return unpivot_month_names(view(spark, d, "kpi_wide"))


@query("unpivot_month_numbers")
def q_unpivot_month_numbers(spark, d):
    return unpivot_month_numbers(view(spark, d, "kpi_long"), kpi.YEAR)


@query("union_long_wide")
def q_union_long_wide(spark, d):
    return financial.combine(view(spark, d, "fin_dirty"), view(spark, d, "fin_wide"))


@query("ocr_fix")
def q_ocr_fix(spark, d):
    return view(spark, d, "fin_dirty").select("order_no", "line_seq", repair_ocr_digits(F.col("amount")).alias("amount"))


@query("normalize_text")
def q_normalize_text(spark, d):
    return view(spark, d, "fin_dirty").select(
        "order_no", "line_seq",
        F.initcap(squeeze(F.col("category"))).alias("category"),
        F.lower(squeeze(F.col("customer_name"))).alias("customer_name"),
        F.upper(squeeze(F.col("category"))).alias("category_upper"),
    )


@query("period_parse")
def q_period_parse(spark, d):
    return view(spark, d, "fin_dirty").select(
        "order_no", "line_seq", F.col("period").alias("period_raw"), parse_period(F.col("period")).alias("period")
    )


@query("amount_cast_flag")
def q_amount_cast_flag(spark, d):
    repaired = view(spark, d, "fin_dirty").select("order_no", "line_seq", F.trim(repair_ocr_digits(F.col("amount"))).alias("amount"))
    typed = repaired.withColumn("amount_numeric", to_amount(F.col("amount")))
    return typed.withColumn("IS_AMOUNT_UNPARSEABLE", flag(F.col("amount").isNotNull() & F.col("amount_numeric").isNull()))


@query("audit_log_changes")
def q_audit_log_changes(spark, d):
    return financial.cleaning_log(_cleaned(spark, d), RUN_TS)


@query("kpi_change_log")
def q_kpi_change_log(spark, d):
    return kpi.cleaning_log(_kpi_long(spark, d), RUN_TS).unionByName(kpi.cleaning_log(_kpi_wide(spark, d), RUN_TS))


@query("issue_log")
def q_issue_log(spark, d):
    return financial.cleaning_issues(_cleaned(spark, d), RUN_TS)


@query("sentinel_fill")
def q_sentinel_fill(spark, d):
    return fill_kpi_sentinels(view(spark, d, "kpi_long")).select("Pillar", "Sub_Pillar", "Department", "KPI_Name", "Sub_KPI_Type")


@query("row_hash")
def q_row_hash(spark, d):
    columns = ["order_no", "category", "customer_name", "period", "amount", "currency"]
    return view(spark, d, "fin_dirty").select("order_no", "line_seq", row_digest(columns).alias("ROW_HASH"))


@query("customer_canonical")
def q_customer_canonical(spark, d):
    named = view(spark, d, "fin_dirty").select("order_no", "line_seq", F.col("customer_name").alias("customer_name_raw"), "customer_name")
    return canonical_customers(named, customer_mapping(spark))


# ---- deduplication and reconciliation ------------------------------------

@query("dedup_keep_highest")
def q_dedup_keep_highest(spark, d):
    return keep_highest(_cleaned_long(spark, d), financial.GRAIN, "amount_numeric", ["line_seq"]).select(
        "order_no", "category", "period", "amount_numeric", "line_seq"
    )


@query("dedup_drop_log")
def q_dedup_drop_log(spark, d):
    return flag_not_highest(_cleaned_long(spark, d), financial.GRAIN, "amount_numeric", ["line_seq"]).filter(
        "IS_DUPLICATE"
    ).select("order_no", "category", "period", "amount", "customer_name", "line_seq")


FULL_ROW = ["order_no", "category", "period", "currency"]


@query("dedup_keep_first")
def q_dedup_keep_first(spark, d):
    return keep_first_equal(_cleaned_long(spark, d), FULL_ROW, ["line_seq"]).select(*FULL_ROW, "line_seq")


@query("dedup_repeat_log")
def q_dedup_repeat_log(spark, d):
    return repeat_log(flag_repeats(_cleaned_long(spark, d), FULL_ROW, ["line_seq"]), ["order_no", "SOURCE_FILE", "line_seq"], FULL_ROW, RUN_TS)


@query("dedup_summary")
def q_dedup_summary(spark, d):
    columns = ["order_no", "category", "period", "currency", "amount"]
    return first_source_summary(_cleaned(spark, d), columns, ["line_seq", "amount_raw"])


@query("kpi_issue_log")
def q_kpi_issue_log(spark, d):
    """Delivered KPI values that are no numbers, of both layouts."""
    long, wide = kpi.at_month_grain(_kpi_long(spark, d), _kpi_wide(spark, d), kpi.YEAR)
    return kpi.value_issues(long, RUN_TS).unionByName(kpi.value_issues(wide, RUN_TS))


@query("reconcile_drop_log")
def q_reconcile_drop_log(spark, d):
    return kpi.dropped_between_sources(_kpi_long(spark, d), _kpi_wide(spark, d), kpi.YEAR, RUN_TS)


@query("kpi_dedup_summary")
def q_kpi_dedup_summary(spark, d):
    return kpi.duplicate_summary(_kpi_long(spark, d)).unionByName(kpi.duplicate_summary(_kpi_wide(spark, d)))


@query("reconcile_sources")
def q_reconcile_sources(spark, d):
    return kpi.unify(_kpi_long(spark, d), _kpi_wide(spark, d), kpi.YEAR)


@query("reconcile_costs")
def q_reconcile_costs(spark, d):
    """The same rule on a large input: long and wide cost deliveries at their grain."""
    columns = ["order_no", "category", "currency", "period", "amount_numeric", "SOURCE_FILE", "Sub_Pillar", "Sub_KPI_Type"]
    cleaned = _cleaned(spark, d).withColumns({"Sub_Pillar": F.lit(" a  b "), "Sub_KPI_Type": F.lit(None).cast("string")}).select(*columns)
    parts = [cleaned.filter(F.col("SOURCE_FILE") == s) for s in (financial.LONG_SOURCE, financial.WIDE_SOURCE)]
    return reconcile_sources(parts, ["order_no", "category", "currency", "period"], "amount_numeric").select(
        "order_no", "category", "currency", "period", "amount_numeric", "IS_CONFLICT", "Sub_Pillar", "Sub_KPI_Type"
    )


def _order_copies(spark, d):
    left = run_sql(spark, d, "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,4)) AS o_totalprice FROM {orders}")
    right = run_sql(
        spark, d,
        """SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_orderkey + 100000000000 ELSE o_orderkey END AS o_orderkey,
                  o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                  CAST(CAST(o_totalprice AS DECIMAL(18,4)) + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS o_totalprice
           FROM {orders}""",
    )
    return left, right


@query("source_diff")
def q_source_diff(spark, d):
    left, right = _order_copies(spark, d)
    return source_diff(left, right, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice"], ["o_totalprice"])


@query("source_diff_keys")
def q_source_diff_keys(spark, d):
    left, right = _order_copies(spark, d)
    return key_differences(left, right, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice"]).drop("row_differs")


@query("source_diff_rows")
def q_source_diff_rows(spark, d):
    """Orders and a copy that differs in a few ranges of keys: changed, missing and repeated rows, located by digests."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    left, right = [
        run_sql(spark, d, f"SELECT o_orderkey, o_custkey, {status} AS o_orderstatus, CAST(o_totalprice AS DECIMAL(18,4)) AS o_totalprice FROM {{orders}}{rest}")
        for status, rest in (
            ("o_orderstatus", ""),
            (
                "CASE WHEN floor(o_orderkey / 64) % 20 = 3 AND o_custkey % 3 = 0 THEN 'X' ELSE o_orderstatus END",
                " LATERAL VIEW explode(sequence(1, CASE WHEN floor(o_orderkey / 64) % 20 = 11 AND o_custkey % 5 = 1 THEN 2 ELSE 1 END)) c AS copy"
                " WHERE floor(o_orderkey / 64) % 20 <> 7 OR o_custkey % 5 <> 0",
            ),
        )
    ]
    return locate_differences(left, right, columns, range_leaf("o_orderkey", 64), scratch_path(spark, "digests-left"), scratch_path(spark, "digests-right"))


# ---- lookups -------------------------------------------------------------

@query("fx_default_row")
def q_fx_default_row(spark, d):
    """Every currency of the reference, the added base row included, with its number of cost lines."""
    used = view(spark, d, "fin_dirty").groupBy(F.col("currency").alias("_code")).agg(F.count(F.lit(1)).alias("cost_lines"))
    dim = dim_currency(view(spark, d, "fx_rates"))
    return dim.join(used, F.col("currency_code") == F.col("_code"), "left").drop("_code")


@query("fx_convert")
def q_fx_convert(spark, d):
    rates = latest_rates(with_base_rate(view(spark, d, "fx_rates")))
    return convert_amounts(_cleaned_long(spark, d), rates).select(
        "order_no", "line_seq", "currency", "amount_numeric", "converted_amount_vnd", "IS_FX_CONVERSION_FAILED"
    )


@query("fx_asof")
def q_fx_asof(spark, d):
    return asof_rates(_cleaned_long(spark, d), view(spark, d, "fx_rates")).select(
        "order_no", "line_seq", "currency", "period", "rate_to_vnd"
    )


@query("orphan_flag")
def q_orphan_flag(spark, d):
    return flag_orphans(view(spark, d, "fin_dirty"), view(spark, d, "erp_orders")).select("order_no", "line_seq", "IS_ORPHANED_ORDER")


@query("orphan_quarantine")
def q_orphan_quarantine(spark, d):
    return quarantine_orphans(view(spark, d, "fin_dirty"), view(spark, d, "erp_orders")).select("order_no", "line_seq", "amount")


@query("orphan_flag_bucketed")
def q_orphan_flag_bucketed(spark, d):
    """Orphans among costs and orders that were written in buckets by order: the join moves no row of either."""
    def bucketed(name, label):
        path = scratch_path(spark, label)
        return write_bucketed(view(spark, d, name), path.rsplit("/", 1)[1].replace("-", "_"), path, "order_no", 16)

    return flag_orphans_bucketed(bucketed("fin_dirty", "bucketed-costs"), bucketed("erp_orders", "bucketed-orders")).select("order_no", "line_seq", "IS_ORPHANED_ORDER")


@query("orphan_promotion")
def q_orphan_promotion(spark, d):
    """Costs and orders in three arrivals, orders often after their costs; two arrivals run again, one after later ones."""
    path = scratch_path(spark, "orphan-tables")
    number = F.substring("order_no", 5, 30).cast("bigint")
    costs = view(spark, d, "fin_dirty").select("order_no", "line_seq", "amount").withColumn("_came", F.pmod(number + F.length("line_seq"), F.lit(3)))
    orders = view(spark, d, "erp_orders").select("order_no").withColumn("_came", F.pmod(number, F.lit(4)))
    for arrival, latest in ((0, 0), (1, 1), (1, 1), (2, 2), (0, 2)):
        settle_arrival(
            spark, costs.filter(F.col("_came") == arrival).drop("_came"), orders.filter(F.col("_came") <= latest).drop("_came"),
            orders.filter(F.col("_came") == arrival).drop("_came"), path, "order_no", arrival,
        )
    return settled_facts(spark, path, ["order_no", "line_seq", "amount"])


@query("customer_review")
def q_customer_review(spark, d):
    """Delivered customer names with spelling errors, each with its nearest known name and how many are near."""
    text = "concat(lower(n_name), ' ', substr(md5(CAST(c_custkey AS STRING)), 1, 12))"
    known = run_sql(spark, d, f"SELECT {text} AS customer_name FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey")
    delivered = run_sql(
        spark, d,
        f"""SELECT CASE c_custkey % 6 WHEN 0 THEN known WHEN 1 THEN concat('x', known) WHEN 2 THEN concat(substr(known, 1, length(known) - 3), 'z', substr(known, length(known) - 1))
                   WHEN 3 THEN concat(substr(known, 1, 1), substr(known, 4)) WHEN 4 THEN concat(known, '-old') ELSE concat(substr(known, 2), 'q') END AS customer_name
            FROM (SELECT c_custkey, {text} AS known FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey)""",
    )
    return review_candidates(delivered, known, "customer_name", "customer_name")


@query("orders_nested_lines")
def q_orders_nested_lines(spark, d):
    headers = map_fields(_order_headers(spark, d), HEADER_FIELDS)
    lines = map_fields(_order_lines(spark, d), LINE_FIELDS)
    nested = nest_lines(headers, lines)
    listed = F.transform("line_items", lambda x: F.concat_ws("/", x["line_id"].cast("string"), x["line_description"], x["buyer_contact"], x["line_notes"]))
    return nested.select(
        "order_id", "customer_id", "order_code", "order_notes", "line_part",
        F.size("line_items").cast("bigint").alias("line_count"), F.array_join(listed, ";").alias("line_items"),
    )


@query("kpi_master_match")
def q_kpi_master_match(spark, d):
    unified = kpi.unify(_kpi_long(spark, d), _kpi_wide(spark, d), kpi.YEAR)
    return match_master(unified, _master(spark, d)).select(
        "PILLAR_ID", "SP_ID", "UA_ID", "Yearly_Target", "Aggregation_Method", "Pillar", "Sub_Pillar", "Department", "KPI_Name",
        "Sub_KPI_Type", "Unit", "PERIOD", "actual_value", "SOURCE_FILE", "Is_Active", "Valid_From", "Valid_To", "Source_Version", "IS_ORPHANED",
    )


@query("scd2_point_in_time")
def q_scd2_point_in_time(spark, d):
    """Every order with the target version of its customer segment that was in force."""
    facts = run_sql(
        spark, d,
        f"""SELECT o_orderkey, c_nationkey * 10 + CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'AUTOMOBILE' THEN 3
                  WHEN 'MACHINERY' THEN 4 ELSE 5 END AS UA_ID, concat(CAST(year(o_orderdate) + {YEAR_SHIFT} AS STRING), '-', date_format(o_orderdate, 'MM')) AS PERIOD
           FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    )
    versions = view(spark, d, "kpi_master").select("UA_ID", "Yearly_Target", "Source_Version", "Valid_From", "Valid_To")
    return point_in_time(facts, versions, "UA_ID", "PERIOD")


@query("as_of_versions")
def q_as_of_versions(spark, d):
    """Every event with the state in force of its user, from a history that changes with every third event."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    states = _user_states(spark, d).filter("event_id % 3 = 0")
    history = build_history(states, "user_id", "ts", ["event_type", "band"], tiebreak=["event_id"], bucket=F.date_trunc("day", "ts"))
    versions = history.select("user_id", "event_type", "band", "Valid_From", "Valid_To")
    met = as_of(events, versions, "user_id", "ts", lambda at: F.date_trunc("day", at))
    return met.select("event_id", "user_id", "event_type", "band", F.unix_micros(F.col("Valid_From").cast("timestamp")).alias("Valid_From"))


# ---- history and dimensions ----------------------------------------------

def _user_states(spark, d):
    return table(spark, d, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.when(F.col("value") >= 50, "HIGH").otherwise("LOW").alias("band"),
        F.get_json_object("props", "$.k").alias("last_k"),
    )


USER_HISTORY = {
    "key": "user_id", "at": "ts", "tracked": ["event_type", "band"], "overwrite": ["last_k"], "tiebreak": ["event_id"], "unit": "band",
}


def _shown_history(history):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return history.select(
        "user_id", "event_type", "band", micros("Valid_From"), micros("Valid_To"), "is_current", "unit_changed", "last_k"
    )


@query("scd2_build")
def q_scd2_build(spark, d):
    """Type 2 on event type and band per user, type 1 on the last property value."""
    return _shown_history(build_history(_user_states(spark, d), **USER_HISTORY, bucket=F.date_trunc("day", "ts")))


@query("scd2_apply")
def q_scd2_apply(spark, d):
    """The same history, from four snapshots that come out of order and overlap in time, the third one twice."""
    path, states = scratch_path(spark, "user-history"), _user_states(spark, d)
    part = F.pmod(F.col("event_id"), F.lit(5))
    for own in ([3, 4], [0, 1], [2], [2]):
        apply_snapshot(spark, states.filter(part.isin(own)), path, **USER_HISTORY, bucket=F.date_trunc("day", "ts"))
    return _shown_history(spark.read.parquet(f"{path}/history"))


@query("dim_kpi")
def q_dim_kpi(spark, d):
    history = build_history(
        view(spark, d, "kpi_master"), "UA_ID", "Valid_From",
        ["Yearly_Target", "Aggregation_Method", "direction", "Department", "PILLAR_ID", "Sub_Pillar"],
        overwrite=["KPI_Name", "Is_Active"], tiebreak=["Source_Version"], far_end=F.lit("9999-12"),
    )
    return history.withColumnRenamed("version_sk", "kpi_sk")


@query("dim_date")
def q_dim_date(spark, d):
    return dim_date(month_bounds(table(spark, d, "orders"), "o_orderdate"))


@query("dim_customer")
def q_dim_customer(spark, d):
    named = view(spark, d, "fin_dirty").select(F.col("customer_name").alias("customer_name_raw"), "customer_name")
    return dim_customer(canonical_customers(named, customer_mapping(spark)))


@query("customer_spellings")
def q_customer_spellings(spark, d):
    named = view(spark, d, "fin_dirty").select(F.col("customer_name").alias("customer_name_raw"), "customer_name")
    return customer_spellings(canonical_customers(named, customer_mapping(spark)))


@query("dim_code_list")
def q_dim_code_list(spark, d):
    return code_dim(table(spark, d, "part"), "p_type", "fabric_type")


@query("fact_order_cost")
def q_fact_order_cost(spark, d):
    dates = dim_date(month_bounds(table(spark, d, "lineitem"), "l_shipdate"))
    return fact_order_cost(_silver_financial(spark, d), dates, dim_currency(view(spark, d, "fx_rates")))


@query("fact_kpi_actual")
def q_fact_kpi_actual(spark, d):
    return _fact_kpi(spark, d)


# ---- aggregation, quality, Gold ------------------------------------------

@query("kpi_dynamic_agg")
def q_kpi_dynamic_agg(spark, d):
    actuals = _fact_kpi(spark, d).select(
        "UA_ID", "PERIOD", F.col("unit").alias("Unit"), F.col("aggregation_method").alias("Aggregation_Method"), "actual_value",
        F.substring("PERIOD", 1, 4).alias("year"),
    )
    stretches = with_stretches(actuals, ["UA_ID", "year"], "Unit", "PERIOD")
    return aggregate_kpis(stretches, ["UA_ID", "year", "Unit", "unit_stretch"]).drop("unit_stretch")


@query("kpi_month_spine")
def q_kpi_month_spine(spark, d):
    versions = view(spark, d, "kpi_master").filter("Is_Active = 'Y'").select("UA_ID", "Yearly_Target", "Valid_From", "Valid_To")
    actuals = _fact_kpi(spark, d).select("UA_ID", "PERIOD", "unit", "actual_value", "is_value_unparseable")
    spine = month_spine(versions, *SPINE)
    return with_missing_months(spine, actuals, ["UA_ID", "PERIOD"], extra=["unit", "is_value_unparseable"], unparseable="is_value_unparseable").drop("is_value_unparseable")


@query("achievement_pct")
def q_achievement_pct(spark, d):
    matched = _silver_kpi(spark, d).filter("not IS_ORPHANED")
    actual, target, aim = F.col("actual_value"), F.col("Yearly_Target"), F.col("direction")
    return matched.select(
        "UA_ID", "PERIOD", "SOURCE_FILE", "actual_value", "Yearly_Target", "direction",
        achievement(actual, target, aim).alias("achievement_pct"),
        is_zero_target(target).alias("zero_target_kpi"),
        is_zero_actual_lower(actual, target, aim).alias("zero_actual_lower"),
    )


@query("achievement_dq_rows")
def q_achievement_dq_rows(spark, d):
    return achievement_findings(_kpi_months(spark, d), ["UA_ID", "period"])


def _quality(spark, d):
    return quality_log(_silver_financial(spark, d), gold.FINANCIAL_EXPECTATIONS).unionByName(
        quality_log(_silver_kpi(spark, d), gold.KPI_EXPECTATIONS)
    )


@query("dq_results")
def q_dq_results(spark, d):
    return _quality(spark, d)


@query("silver_write_log")
def q_silver_write_log(spark, d):
    """Silver costs written, with the log of their checks and the run's totals, all counted by the write itself."""
    silver = _silver_financial(spark, d).select(*financial.SILVER_COLUMNS)
    done = write_observed(silver, scratch_path(spark, "silver-costs"), gold.FINANCIAL_EXPECTATIONS, financial.summary_counts(), unique=True)
    totals = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(v).cast("bigint").alias("row_count")) for n, v in done.counts.items()])
    listed = spark.range(1).select(F.inline(totals)).withColumns({"table_name": F.lit("silver_financial"), "result": F.lit("COUNT"), "details": F.lit("")})
    return done.log.unionByName(listed.select(*done.log.columns))


@query("dq_raw_costs")
def q_dq_raw_costs(spark, d):
    """The checks on uncleaned costs, where they must fail."""
    return quality_log(
        view(spark, d, "fin_dirty"),
        gold.Expectations("bronze_financial", ("order_no", "category", "period"), ("order_no", "line_seq", "supplier_no"), {"amount": None}),
    )


@query("dq_null_counts")
def q_dq_null_counts(spark, d):
    return null_counts(_cleaned_long(spark, d).select("order_no", "category", "period", "amount", "amount_numeric", "currency", "mapping_rule_id"))


@query("dq_gate")
def q_dq_gate(spark, d):
    return quality_gate(_quality(spark, d))


@query("run_summary")
def q_run_summary(spark, d):
    return financial.run_summary(_silver_financial(spark, d))


@query("gold_order_cost")
def q_gold_order_cost(spark, d):
    return gold.order_cost_summary(_silver_financial(spark, d))


@query("gold_cost_incremental")
def q_gold_cost_incremental(spark, d):
    """The cost mart after two upserts of Silver costs: first with other amounts, months and orders, then as they are."""
    path, mart = scratch_path(spark, "silver-costs"), scratch_path(spark, "cost-mart")
    silver = staged(with_year_month(_silver_financial(spark, d).select(*financial.SILVER_COLUMNS), "period"), "silver-costs")
    turn = F.pmod(F.xxhash64(*financial.GRAIN), F.lit(10))
    first = silver.filter(turn != 9).withColumns({
        "converted_amount_vnd": F.when(turn == 3, F.col("converted_amount_vnd") * 2 + 1).when(turn != 4, F.col("converted_amount_vnd")).cast("decimal(38,2)"),
        "customer_name": F.when(turn == 5, F.lit("Someone Else")).otherwise(F.col("customer_name")),
        "IS_ORPHANED_ORDER": F.when(turn == 6, ~F.col("IS_ORPHANED_ORDER")).otherwise(F.col("IS_ORPHANED_ORDER")),
    })
    second = silver.filter(turn.isin(2, 3, 4, 5, 6, 9)).withColumn("converted_amount_vnd", F.col("converted_amount_vnd").cast("decimal(38,2)"))
    for load in (first, second):
        with staging(spark) as stage:  # a change is of no use once the mart has it
            gold.refresh_order_cost(spark, upsert_changes(spark, load, path, financial.GRAIN, [F.lit(1)], stage=stage), mart)
    return gold.order_cost_of(spark.read.parquet(mart))


@query("gold_ytd_incremental")
def q_gold_ytd_incremental(spark, d):
    """Year-to-date values after a change of some KPI months: only the touched KPI years are built anew."""
    path, mart = scratch_path(spark, "kpi-months"), scratch_path(spark, "ytd-mart")
    months = staged(_kpi_months(spark, d), "kpi-months")
    turn = F.pmod(F.xxhash64("UA_ID", "period"), F.lit(7))
    first = months.filter(turn != 0).withColumn("actual_value", F.when(turn == 1, F.lit(None)).when(turn == 2, F.col("actual_value") + 10).otherwise(F.col("actual_value")).cast("decimal(18,4)"))
    for load in (first, months.filter(turn < 3)):
        changes = upsert_changes(spark, load, path, ["UA_ID", "period", "unit"], [F.lit(1)])
        gold.refresh_ytd(spark, changes, spark.read.parquet(path), mart)
    return spark.read.parquet(mart)


@query("gold_kpi_achievement")
def q_gold_kpi_achievement(spark, d):
    return _kpi_months(spark, d)


@query("gold_pillar_rollup")
def q_gold_pillar_rollup(spark, d):
    return gold.pillar_rollup(_kpi_months(spark, d))


@query("gold_ytd")
def q_gold_ytd(spark, d):
    return gold.ytd_actuals(_kpi_months(spark, d))


@query("gold_load")
def q_gold_load(spark, d):
    """Silver written, checked into a log, passed by the gate and built into Gold; the rows of every table that this leaves."""
    path = scratch_path(spark, "gold-load")
    costs = write_observed(_silver_financial(spark, d).select(*financial.SILVER_COLUMNS), f"{path}/silver_costs", gold.FINANCIAL_EXPECTATIONS, unique=True)
    kpis = write_observed(_silver_kpi(spark, d), f"{path}/silver_kpi", gold.KPI_EXPECTATIONS)
    fact = staged(fact_kpi_actual(kpis.table, [kpi.LONG_SOURCE, kpi.WIDE_SOURCE]), "fact-kpi")
    log = costs.log.unionByName(kpis.log)
    names = ["dq_log", *gold.build_gold(costs.table, kpis.table, fact, view(spark, d, "kpi_master"), FIRST_MONTH, LAST_MONTH, path, log)]
    counted = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n in names]
    return functools.reduce(DataFrame.unionByName, counted)


@query("orders_pipeline")
def q_orders_pipeline(spark, d):
    """Landed page files to Bronze records and quarantine, from Bronze to nested orders; quarantined documents follow the orders."""
    landed, bronze = scratch_path(spark, "order-pages"), scratch_path(spark, "order-bronze")
    for kind, pages in (("headers", _order_pages(spark, d)), ("lines", _line_pages(spark, d))):
        pages.select(F.regexp_replace("document", r"[\r\n]", " ").alias("value")).write.option("compression", "gzip").text(f"{landed}/{kind}")
        documents = landed_documents(spark, f"{landed}/{kind}")
        raw_records(flatten_pages(documents)).write.parquet(f"{bronze}/{kind}")
        # A landed line has no page name; its digest names the document.
        quarantine_pages(documents.withColumn("page", F.sha2("document", 256)), f"GET /orders/{kind}", RUN_TS).write.parquet(f"{bronze}/errors/kind={kind}")

    def fields(kind, names):
        parsed = spark.read.parquet(f"{bronze}/{kind}").select(F.parse_json("record_json").alias("record"))
        return record_fields(parsed, {name: (source, "bigint" if source in NUMERIC_IDS else "string") for source, name in names.items()})

    nested = nest_lines(fields("headers", HEADER_FIELDS), fields("lines", LINE_FIELDS))
    listed = F.transform("line_items", lambda x: F.concat_ws("/", x["line_id"].cast("string"), x["line_description"]))
    orders = nested.select("order_id", "customer_id", "order_code", "order_notes", "line_part", F.array_join(listed, ";").alias("line_items"))
    errors = spark.read.parquet(f"{bronze}/errors").select(F.col("error_type").alias("error_type"), F.col("raw_document").alias("raw_document"), "endpoint")
    return orders.unionByName(errors, allowMissingColumns=True)


@query("silver_financial")
def q_silver_financial(spark, d):
    return _silver_financial(spark, d).select(*financial.SILVER_COLUMNS)


@query("silver_kpi")
def q_silver_kpi(spark, d):
    return _silver_kpi(spark, d)
