"""Deliveries in the shape the engine reads, derived from the given tables.

Each view is SQL that Spark and DuckDB both run, so a query and its oracle see
the same rows. ``{name}`` is a table, a double quote marks an identifier.
"""

from __future__ import annotations

import calendar
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

RUN_TS = "2024-01-31 06:00:00"
# Orders of one year are reported as KPIs of YEAR_SHIFT years later: two-digit years mean 20xx. The wide layouts
# carry months as columns, so they have one for every month of these years, which hold all dates of the given tables.
ORDER_YEARS, YEAR_SHIFT = range(1995, 2002), 28
MONTHS = range(1, 13)
ALL_MONTHS = [(y, m) for y in ORDER_YEARS for m in MONTHS]
MONTH_ENDS = [f"{calendar.monthrange(y, m)[1]:02d}/{m:02d}/{y}" for y, m in ALL_MONTHS]
MONTH_NAMES = [f"{calendar.month_abbr[m]}-{(y + YEAR_SHIFT) % 100}" for y, m in ALL_MONTHS]
PERIODS = [f"{y + YEAR_SHIFT}-{m:02d}" for y, m in ALL_MONTHS]

_FULL_NAME = "'January  February March    April    May      June     July     August   SeptemberOctober  November December '"
_SHORT_NAME = "'JanFebMarAprMayJunJulAugSepOctNovDec'"
_YEAR = "CAST(year(l_shipdate) AS STRING)"
_MONTH = "lpad(CAST(month(l_shipdate) AS STRING), 2, '0')"

_LINE_JOINS = """FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
     JOIN {part} ON l_partkey = p_partkey"""

FIN_DIRTY = f"""
SELECT concat('ORD-', CAST(l_orderkey AS STRING)) AS order_no,
       CASE l_linenumber % 3 WHEN 0 THEN concat('  ', lower(p_type), ' ') WHEN 1 THEN p_type
            ELSE concat(p_type, '  CLASS') END AS category,
       CASE WHEN c_custkey % 10 = 0 THEN CASE l_linenumber % 4 WHEN 0 THEN 'Sunrise Apparel' WHEN 1 THEN 'SUNRISE  APPAREL'
                 WHEN 2 THEN ' sunrise apparel inc.' ELSE 'Sunrise Garments' END
            WHEN c_custkey % 10 = 1 THEN concat('o''brien-', c_mktsegment) ELSE upper(c_name) END AS customer_name,
       CASE l_linenumber % 7
            WHEN 0 THEN concat({_YEAR}, '-', {_MONTH})
            WHEN 1 THEN concat({_YEAR}, '/', {_MONTH})
            WHEN 2 THEN concat(trim(substr({_FULL_NAME}, (month(l_shipdate) - 1) * 9 + 1, 9)), ' ', {_YEAR})
            WHEN 3 THEN concat({_MONTH}, '-', {_YEAR})
            WHEN 4 THEN concat(substr({_SHORT_NAME}, (month(l_shipdate) - 1) * 3 + 1, 3), ' ', {_YEAR})
            WHEN 5 THEN 'Q1 FY' ELSE NULL END AS period,
       CASE WHEN l_suppkey % 10 = 0 THEN 'N/A' WHEN l_suppkey % 10 = 1 THEN NULL
            WHEN l_linenumber % 2 = 0 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), '0', 'O')
            ELSE concat(' ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) END AS amount,
       CASE l_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'VND' ELSE 'GBP' END AS currency,
       concat_ws('/', CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_quantity AS STRING),
                 CAST(l_shipdate AS STRING), CAST(l_linenumber AS STRING)) AS line_seq
{_LINE_JOINS}
"""

_WIDE_AMOUNTS = ",\n       ".join(
    f"replace(CAST(sum(CASE WHEN month_no = {y * 100 + m} THEN price END) AS STRING), '0', '{'O' if m % 2 else '0'}') AS \"{end}\""
    for (y, m), end in zip(ALL_MONTHS, MONTH_ENDS)
)
FIN_WIDE = f"""
SELECT concat('ORD-', CAST(l_orderkey AS STRING)) AS order_no, p_type AS category,
       concat(' ', c_name) AS customer_name, CASE WHEN c_nationkey % 2 = 0 THEN 'USD' ELSE 'VND' END AS currency,
       {_WIDE_AMOUNTS}
FROM (SELECT l_orderkey, p_type, c_name, c_nationkey, year(l_shipdate) * 100 + month(l_shipdate) AS month_no,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS price
      FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
           JOIN {{part}} ON l_partkey = p_partkey) l
GROUP BY l_orderkey, p_type, c_name, c_nationkey
"""

# orders of status P are unknown to the ERP, so their costs are orphans
ERP_ORDERS = """
SELECT concat('ORD-', CAST(o_orderkey AS STRING)) AS order_no, o_custkey AS customer_id
FROM {orders} WHERE o_orderstatus <> 'P'
"""

# no row for the base currency and none for GBP
FX_RATES = """
SELECT currency_code, currency, rate_to_vnd, effective_date, 'MARKET' AS rate_type FROM (VALUES
  ('USD', 'US Dollar', '24000.0', '1995-01-01'), ('USD', 'US Dollar', '24500.5', '1998-01-01'),
  ('EUR', 'Euro', '26000.0', '1995-01-01'), ('EUR', 'Euro', '27100.25', '1997-06-01'))
  t(currency_code, currency, rate_to_vnd, effective_date)
"""

_KPI_ROWS = """(SELECT r_name, n_nationkey, n_name, c_mktsegment, year(o_orderdate) AS order_year, month(o_orderdate) AS order_month,
             year(o_orderdate) * 100 + month(o_orderdate) AS month_no, CAST(o_totalprice AS DECIMAL(18,2)) AS price
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
           JOIN {region} ON n_regionkey = r_regionkey) o"""
_KPI_KEYS = """r_name AS Pillar, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE concat(' ', n_name, '  sub') END AS Sub_Pillar,
       n_name AS Department, c_mktsegment AS KPI_Name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'All' END AS Sub_KPI_Type"""


def _month_text(month: int) -> str:
    """The value of one month as delivered: even months with letters for zeros, some that are no numbers."""
    total = f"CAST(sum(CASE WHEN order_month = {month} THEN price END) AS STRING)"
    text = f"replace({total}, '0', '{'O' if month % 2 == 0 else '0'}')"
    odd = {3: (1, "n/a"), 4: (2, "1,200")}.get(month)
    return f"CASE WHEN n_nationkey % 6 = {odd[0]} THEN '{odd[1]}' ELSE {text} END" if odd else text


# a row per year; some rows come twice, of which some with another target
_LONG_VALUES = ",\n       ".join(f"{_month_text(m)} AS M{m}" for m in MONTHS)


def _kpi_long(target: str, having: str) -> str:
    return f"""SELECT {_KPI_KEYS}, CASE WHEN c_mktsegment = 'FURNITURE' THEN '%' ELSE 'NUMBER' END AS Unit,
       order_year + {YEAR_SHIFT} AS Year, {target} AS Target,
       {_LONG_VALUES}
FROM {_KPI_ROWS}
GROUP BY r_name, n_nationkey, n_name, c_mktsegment, order_year{having}"""


KPI_LONG = (
    _kpi_long("CASE WHEN n_nationkey % 8 = 3 THEN '100.5' END", "")
    + "\nUNION ALL\n"
    + _kpi_long("CASE WHEN n_nationkey % 8 = 3 THEN '99.5' END", " HAVING n_nationkey % 8 IN (3, 5)")
)

# every seventh value differs from the long delivery, some departments are not delivered, some KPIs have another unit
_WIDE_VALUES = ",\n       ".join(
    f"CAST(sum(CASE WHEN month_no = {y * 100 + m} THEN price END) + CASE WHEN (n_nationkey + {m}) % 7 = 0 THEN 1 ELSE 0 END AS STRING) AS \"{name}\""
    for (y, m), name in zip(ALL_MONTHS, MONTH_NAMES)
)
KPI_WIDE = f"""SELECT {_KPI_KEYS},
       CASE WHEN c_mktsegment = 'FURNITURE' OR c_mktsegment = 'HOUSEHOLD' AND n_nationkey % 9 = 4 THEN '%' ELSE 'NUMBER' END AS Unit,
       {_WIDE_VALUES}
FROM {_KPI_ROWS}
GROUP BY r_name, n_nationkey, n_name, c_mktsegment HAVING n_nationkey % 11 <> 10"""

# two versions of MACHINERY, FURNITURE retired, EUROPE unknown
KPI_MASTER = """
SELECT r_name AS Pillar, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE concat(n_name, ' sub') END AS Sub_Pillar,
       n_name AS Department, seg AS KPI_Name, CASE WHEN seg = 'BUILDING' THEN NULL ELSE 'All' END AS Sub_KPI_Type,
       n_nationkey * 10 + seg_no AS UA_ID, n_regionkey AS PILLAR_ID, n_nationkey AS SP_ID,
       method AS Aggregation_Method, direction, CAST(target AS DECIMAL(18,4)) AS Yearly_Target, active AS Is_Active,
       valid_from AS Valid_From, valid_to AS Valid_To, version AS Source_Version
FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}) k JOIN {nation} ON c_nationkey = n_nationkey
     JOIN {region} ON n_regionkey = r_regionkey
     JOIN (VALUES
  ('BUILDING', 1, 'SUM', 'HIGHER', 900000, 'Y', '2023-01', '9999-12', 'v1'),
  ('HOUSEHOLD', 2, 'LAST', 'HIGHER', 150000, 'Y', '2023-01', '9999-12', 'v1'),
  ('AUTOMOBILE', 3, 'AVERAGE', 'LOWER', 0, 'Y', '2023-01', '9999-12', 'v1'),
  ('MACHINERY', 4, 'AVERAGE', 'LOWER', 120000, 'Y', '2023-01', '2024-06', 'v1'),
  ('MACHINERY', 4, 'AVERAGE', 'LOWER', 100000, 'Y', '2024-06', '9999-12', 'v2'),
  ('FURNITURE', 5, 'AVERAGE', 'HIGHER', 1, 'N', '2023-01', '9999-12', 'v1'))
  s(seg, seg_no, method, direction, target, active, valid_from, valid_to, version) ON seg = c_mktsegment
WHERE r_name <> 'EUROPE'
"""

# How Spark builds the two cost layouts, with the same rows. Lines meet the part table first and the smaller join of
# orders and customers last, on the order number that both layouts show, so that one shuffle by it serves the wide
# layout's groups and what later steps do by order. Sums are taken per month and row of the wide layout, and only then
# laid out, so no row of 84 sums is ever sorted, shuffled or kept in a hash table.
_ORDER_NO = "concat('ORD-', CAST({key} AS STRING))"


def _lines_by_order(columns: str) -> str:
    return f"""FROM (SELECT {_ORDER_NO.format(key="l_orderkey")} AS order_no, {columns} FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) l
     JOIN (SELECT {_ORDER_NO.format(key="o_orderkey")} AS order_known, c_custkey, c_name, c_nationkey, c_mktsegment
           FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) o ON order_no = order_known"""


_WIDE_CELLS = ",\n       ".join(
    f"replace(CAST(try_element_at(cells, {y * 100 + m}) AS STRING), '0', '{'O' if m % 2 else '0'}') AS \"{end}\""
    for (y, m), end in zip(ALL_MONTHS, MONTH_ENDS)
)
_WIDE_BY_MONTH = f"""
SELECT order_no, p_type AS category,
       concat(' ', c_name) AS customer_name, CASE WHEN c_nationkey % 2 = 0 THEN 'USD' ELSE 'VND' END AS currency,
       {_WIDE_CELLS}
FROM (SELECT order_no, p_type, c_name, c_nationkey,
             map_from_entries(collect_list(CASE WHEN month_no BETWEEN {ALL_MONTHS[0][0] * 100 + 1} AND {ALL_MONTHS[-1][0] * 100 + 12} THEN struct(month_no, total) END)) AS cells
      FROM (SELECT order_no, p_type, c_name, c_nationkey, year(l_shipdate) * 100 + month(l_shipdate) AS month_no,
                   sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
            {_lines_by_order("p_type, l_shipdate, l_extendedprice")}
            GROUP BY order_no, p_type, c_name, c_nationkey, month_no) m
      GROUP BY order_no, p_type, c_name, c_nationkey) w
"""
_DIRTY_BY_ORDER = FIN_DIRTY.replace(_ORDER_NO.format(key="l_orderkey"), "order_no").replace(
    _LINE_JOINS, _lines_by_order("p_type, l_linenumber, l_shipdate, l_suppkey, l_partkey, l_quantity, l_extendedprice")
)
SPARK_VIEWS = {"fin_dirty": _DIRTY_BY_ORDER, "fin_wide": _WIDE_BY_MONTH}

VIEWS = {
    "fin_dirty": FIN_DIRTY,
    "fin_wide": FIN_WIDE,
    "erp_orders": ERP_ORDERS,
    "fx_rates": FX_RATES,
    "kpi_long": KPI_LONG,
    "kpi_wide": KPI_WIDE,
    "kpi_master": KPI_MASTER,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the table that drives a view, and columns that spread its rows
DRIVING = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",)}
# A caller whose delivered files cannot be split asks for so many tasks behind their scan.
SCAN_TASKS = "spark.tallyloom.scanTasks"


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run shared SQL on the tables of one folder."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    driving = next((t for t in DRIVING if t in used), None)
    tasks = spark.conf.get(SCAN_TASKS, None)
    if driving and tasks:
        used[driving] = used[driving].repartition(int(tasks), *DRIVING[driving])
    return spark.sql(text.replace('"', "`"), **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, SPARK_VIEWS.get(name, VIEWS[name]))


def oracle_view(name: str) -> str:
    """The view as DuckDB text."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).strip()
