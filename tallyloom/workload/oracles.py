"""The same queries as SQL for DuckDB, written from the semantics, not from the Spark plans."""

from __future__ import annotations

import re

from tallyloom.operators.lookup import CUSTOMER_NAMES
from tallyloom.workload.views import MONTH_ENDS, MONTH_NAMES, MONTHS, PERIODS, RUN_TS, VIEWS, oracle_view

LONG_FIN, WIDE_FIN = "financial_long_format.csv", "financial_wide_format.csv"
LONG_KPI, WIDE_KPI = "kpi_actual_long.csv", "kpi_actual_wide.csv"
KPI_KEYS = ["Pillar", "Sub_Pillar", "Department", "KPI_Name", "Sub_KPI_Type", "Unit"]
KEY_LIST = ", ".join(KPI_KEYS)


# ---- expressions ---------------------------------------------------------

def ocr(x):
    return rf"CASE WHEN regexp_matches({x}, '^[0-9Oo\.\,\-\s]+$') THEN replace(replace({x}, 'O', '0'), 'o', '0') ELSE {x} END"


def squeeze(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def initcap(x):
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def title(x):
    return f"array_to_string(list_transform(regexp_extract_all({x}, '([a-z]+|[^a-z]+)'), lambda w: upper(w[1]) || w[2:]), '')"


def period(x):
    shapes = [
        (r"^\d{4}-\d{2}$", "%Y-%m"), (r"^\d{4}/\d{2}$", "%Y/%m"), (r"^\d{2}-\d{4}$", "%m-%Y"),
        (r"^[A-Za-z]{3} \d{4}$", "%b %Y"), (r"^[A-Za-z]{4,} \d{4}$", "%B %Y"),
    ]
    cases = " ".join(f"WHEN regexp_matches(trim({x}), '{s}') THEN try_strptime(trim({x}), '{f}')" for s, f in shapes)
    return f"coalesce(strftime(CASE {cases} END, '%Y-%m'), {x})"


def amount(x):
    return f"TRY_CAST(trim({x}) AS DECIMAL(18,4))"


def digest(*columns):
    return "sha256(concat_ws('||', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns) + "))"


def sk(*columns):
    return f"CAST('0x' || substr({digest(*columns)}, 1, 15) AS BIGINT)"


def mapped(variant, what):
    pick = {"name": lambda i, v, n: n, "rule": lambda i, v, n: f"MAP-{i + 1:03d}"}[what]
    cases = " ".join(f"WHEN '{v}' THEN '{pick(i, v, n)}'" for i, (v, n) in enumerate(CUSTOMER_NAMES.items()))
    return f"CASE {variant} {cases} END"


def ratio(num, den, digits):
    """num/den rounded half up, exact: both non-negative decimals of scale 4."""
    n, d = f"CAST(({num}) * 10000 AS HUGEINT)", f"CAST(({den}) * 10000 AS HUGEINT)"
    return f"(CAST((2 * {n} * {10 ** digits} + {d}) // (2 * {d}) AS DOUBLE) / {10 ** digits})"


def mean4(total, n):
    """Mean of scale-4 decimals, rounded half up to four digits."""
    t = f"CAST(({total}) * 10000 AS HUGEINT)"
    return f"(CAST((2 * {t} + {n}) // (2 * {n}) AS DOUBLE) / 10000)"


def canonical(p, part):
    start, size, kind = {"year": (1, 4, "INTEGER"), "month": (6, 2, "INTEGER")}[part]
    return rf"CASE WHEN regexp_matches({p}, '^\d{{4}}-\d{{2}}$') THEN CAST(substr({p}, {start}, {size}) AS {kind}) END"


def achieved(actual, target, direction):
    return (
        f"CASE WHEN {target} = 0 THEN NULL WHEN {direction} = 'LOWER' AND {actual} <> 0 THEN {ratio(target, actual, 6)} "
        f"WHEN {direction} = 'HIGHER' THEN {ratio(actual, target, 6)} END"
    )


# ---- building blocks -----------------------------------------------------

CTES = {name: oracle_view(name) for name in VIEWS}

CTES["fin_wide_tall"] = f"""
SELECT order_no, category, customer_name, currency, amount, strftime(strptime(token, '%d/%m/%Y'), '%Y-%m') AS period
FROM (UNPIVOT fin_wide ON {", ".join(f'"{m}"' for m in MONTH_ENDS)} INTO NAME token VALUE amount)"""

CTES["combined"] = f"""
SELECT order_no, category, customer_name, period, amount, currency, line_seq, '{LONG_FIN}' AS SOURCE_FILE FROM fin_dirty
UNION ALL
SELECT order_no, category, customer_name, period, amount, currency, NULL, '{WIDE_FIN}' FROM fin_wide_tall"""

CTES["cleaned"] = f"""
SELECT *, {amount("amount")} AS amount_numeric,
       amount IS NOT NULL AND {amount("amount")} IS NULL AS IS_AMOUNT_UNPARSEABLE,
       coalesce({mapped("variant", "name")}, {title("variant")}) AS customer_name,
       CASE WHEN {mapped("variant", "name")} IS NOT NULL THEN 'MATCHED' WHEN coalesce(variant, '') = '' THEN 'REVIEW' ELSE 'UNMATCHED' END AS normalization_status,
       {mapped("variant", "rule")} AS mapping_rule_id
FROM (SELECT order_no, currency, line_seq, SOURCE_FILE, amount AS amount_raw, {ocr("amount")} AS amount_repaired,
             trim({ocr("amount")}) AS amount, period AS period_raw, {period("period")} AS period,
             {initcap(squeeze("category"))} AS category, customer_name AS customer_name_raw,
             lower({squeeze("customer_name")}) AS variant
      FROM combined)"""

CTES["cleaned_long"] = f"SELECT * FROM cleaned WHERE SOURCE_FILE = '{LONG_FIN}'"

CTES["latest"] = """
SELECT currency_code, CAST(rate_to_vnd AS DECIMAL(18,6)) AS rate FROM fx_rates
QUALIFY row_number() OVER (PARTITION BY currency_code ORDER BY effective_date DESC) = 1
UNION ALL SELECT 'VND', CAST(1 AS DECIMAL(18,6))"""

_CONVERTED = "CAST(round(CAST(amount_numeric AS DECIMAL(20,4)) * CAST(rate AS DECIMAL(14,6)), 2) AS DECIMAL(18,4))"

CTES["silver_fin"] = f"""
SELECT c.*, e.order_no IS NULL AS IS_ORPHANED_ORDER, false AS IS_DUPLICATE, {_CONVERTED} AS converted_amount_vnd,
       {_CONVERTED} IS NULL AS IS_FX_CONVERSION_FAILED
FROM (SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY order_no, category, period
      ORDER BY amount_numeric DESC NULLS LAST, line_seq NULLS LAST, SOURCE_FILE, currency, amount_raw NULLS LAST) = 1) c
LEFT JOIN erp_orders e ON c.order_no = e.order_no LEFT JOIN latest ON currency = currency_code"""


def _kpi_clean(view, values):
    cells = ", ".join(f'{ocr(q(v))} AS {q(v)}' for v in values)
    raw = ", ".join(f'{q(v)} AS "_raw_{v}"' for v in [*KPI_KEYS, *values])
    texts = ", ".join(f"{'upper(' + squeeze(k) + ')' if k == 'Pillar' else squeeze(k)} AS {k}" for k in KPI_KEYS)
    year = ["Year"] if view == "kpi_long" else []
    return f"SELECT {digest(*KPI_KEYS, *year)} AS ROW_ID, {''.join(y + ', ' for y in year)}{texts}, {cells}, {raw} FROM {view}"


def q(name):
    return f'"{name}"'


LONG_MONTHS = [f"M{m}" for m in MONTHS]
LONG_VALUES = [*LONG_MONTHS, "Target"]
CTES["long_clean"] = _kpi_clean("kpi_long", LONG_VALUES)
CTES["wide_clean"] = _kpi_clean("kpi_wide", MONTH_NAMES)


CTES["long_once"] = f"""SELECT DISTINCT Year, {KEY_LIST}, {", ".join(q(v) for v in LONG_VALUES)} FROM long_clean"""
CTES["wide_once"] = f"""SELECT DISTINCT {KEY_LIST}, {", ".join(q(v) for v in MONTH_NAMES)} FROM wide_clean"""


def _tall(source, cells, target, source_file, rank):
    rows = "\nUNION ALL\n".join(f"SELECT {KEY_LIST}, trim({q(c)}) AS text, {target} AS Target, {period} AS PERIOD FROM {source}" for c, period in cells)
    return f"""SELECT Pillar, coalesce(nullif({squeeze("Sub_Pillar")}, ''), 'UNKNOWN') AS Sub_Pillar, Department, KPI_Name,
       coalesce(nullif(trim(Sub_KPI_Type), ''), 'N/A') AS Sub_KPI_Type, Unit, {amount("text")} AS actual_value,
       CASE WHEN text <> '' AND {amount("text")} IS NULL THEN text END AS unparsed_text, Target, PERIOD, '{source_file}' AS SOURCE_FILE, {rank} AS source_rank
FROM ({rows})"""


_LONG_CELLS = [(c, f"CAST(Year AS VARCHAR) || '-{m:02d}'") for m, c in zip(MONTHS, LONG_MONTHS)]
_WIDE_CELLS = [(c, f"'{p}'") for p, c in zip(PERIODS, MONTH_NAMES)]
CTES["kpi_tall"] = f"""
SELECT *, coalesce(CAST(actual_value AS VARCHAR), unparsed_text) AS stated FROM (
{_tall("long_once", _LONG_CELLS, amount("Target"), LONG_KPI, 0)}
UNION ALL
{_tall("wide_once", _WIDE_CELLS, "CAST(NULL AS DECIMAL(18,4))", WIDE_KPI, 1)})"""

CTES["kpi_issue_rows"] = "SELECT * FROM kpi_tall WHERE unparsed_text IS NOT NULL"

CTES["kpi_ranked"] = f"""
SELECT *, row_number() OVER (PARTITION BY {KEY_LIST}, PERIOD, stated ORDER BY source_rank, Target NULLS LAST) AS place,
       count(stated) OVER (PARTITION BY {KEY_LIST}, PERIOD) AS all_given FROM kpi_tall"""

CTES["unified"] = f"""
SELECT {KEY_LIST}, Target, SOURCE_FILE, actual_value, unparsed_text, PERIOD, false AS IS_DUPLICATE,
       coalesce(low <> high, false) AS IS_CONFLICT, unparsed_text IS NOT NULL AS IS_VALUE_UNPARSEABLE
FROM (SELECT *, min(stated) OVER grain AS low, max(stated) OVER grain AS high, count(stated) OVER grain AS given
      FROM (SELECT * FROM kpi_ranked WHERE place = 1) WINDOW grain AS (PARTITION BY {KEY_LIST}, PERIOD))
WHERE stated IS NOT NULL OR given = 0"""

CTES["master"] = """
SELECT * REPLACE (coalesce(Sub_Pillar, 'UNKNOWN') AS Sub_Pillar, coalesce(Sub_KPI_Type, 'N/A') AS Sub_KPI_Type) FROM kpi_master"""

_MATCH = "u.Pillar = m.Pillar AND u.Sub_Pillar = m.Sub_Pillar AND u.Department = m.Department AND u.KPI_Name = m.KPI_Name AND u.Sub_KPI_Type = m.Sub_KPI_Type AND m.Is_Active = 'Y'"
_MASTER_COLUMNS = "m.PILLAR_ID, m.SP_ID, m.UA_ID, m.Yearly_Target, m.Aggregation_Method, m.direction, m.Is_Active, m.Valid_From, m.Valid_To, m.Source_Version"

CTES["silver_kpi_rows"] = f"""
SELECT u.*, {_MASTER_COLUMNS}, m.UA_ID IS NULL AS IS_ORPHANED,
       {digest("m.PILLAR_ID", "m.SP_ID", "m.UA_ID", "u.Pillar", "u.Sub_Pillar", "u.Department", "u.KPI_Name", "u.Sub_KPI_Type", "u.Unit", "u.PERIOD", "u.actual_value")} AS ROW_HASH
FROM unified u LEFT JOIN master m ON {_MATCH} AND u.PERIOD >= m.Valid_From AND u.PERIOD < m.Valid_To"""

CTES["fact_kpi"] = f"""
SELECT * FROM silver_kpi_rows WHERE NOT IS_ORPHANED
QUALIFY row_number() OVER (PARTITION BY UA_ID, PERIOD, Unit ORDER BY actual_value IS NULL, CASE SOURCE_FILE WHEN '{LONG_KPI}' THEN 0 ELSE 1 END, ROW_HASH) = 1"""


def _spine(first, last):
    return f"""SELECT UA_ID, PILLAR_ID, Aggregation_Method, direction, Yearly_Target, Valid_From, Valid_To, PERIOD
FROM kpi_master, (SELECT strftime(m, '%Y-%m') AS PERIOD FROM generate_series(DATE '{first}-01', DATE '{last}-01', INTERVAL 1 MONTH) s(m))
WHERE Is_Active = 'Y' AND PERIOD >= Valid_From AND PERIOD < Valid_To"""


CTES["kpi_months"] = f"""
SELECT {sk("s.UA_ID", "s.Valid_From")} AS kpi_sk, s.UA_ID, s.PILLAR_ID, s.PERIOD AS period, f.Unit AS unit, s.Aggregation_Method AS aggregation_method,
       s.direction, f.actual_value, s.Yearly_Target AS target_value, {achieved("f.actual_value", "s.Yearly_Target", "s.direction")} AS achievement_pct,
       s.Yearly_Target = 0 AS zero_target_kpi,
       coalesce(s.direction = 'LOWER' AND f.actual_value = 0 AND s.Yearly_Target <> 0, false) AS zero_actual_lower,
       f.actual_value IS NULL AND NOT coalesce(f.IS_VALUE_UNPARSEABLE, false) AS is_missing_actual,
       coalesce(f.IS_VALUE_UNPARSEABLE, false) AS is_value_unparseable, coalesce(f.IS_CONFLICT, false) AS is_conflict,
       {canonical("s.PERIOD", "year")} AS year, {canonical("s.PERIOD", "month")} AS month
FROM ({_spine(PERIODS[0], PERIODS[-1])}) s LEFT JOIN fact_kpi f ON s.UA_ID = f.UA_ID AND s.PERIOD = f.PERIOD"""

CTES["order_pages"] = """
SELECT page, page % 7 AS kind, '[' || string_agg('{"id":' || id || ',"userId":' || userId || ',"title":"' || title || '"' ||
       CASE WHEN body IS NULL THEN '' ELSE ',"body":"' || body || '"' END || '}', ',' ORDER BY id) || ']' AS list
FROM (SELECT o_orderkey AS id, o_custkey AS userId, 'ORD-' || o_orderkey AS title,
             CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS body, o_orderkey // 500 AS page FROM orders) GROUP BY page"""

CTES["copy_left"] = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,4)) AS o_totalprice FROM orders"
CTES["copy_right"] = """
SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_orderkey + 100000000000 ELSE o_orderkey END AS o_orderkey,
       o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(18,4)) + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS o_totalprice
FROM orders"""
CTES["copies"] = """
SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN l.o_orderkey IS NULL THEN 0 ELSE 1 END AS left_rows,
       CASE WHEN r.o_orderkey IS NULL THEN 0 ELSE 1 END AS right_rows,
       coalesce(l.o_custkey <> r.o_custkey, false) AS o_custkey_differs,
       coalesce(l.o_orderstatus <> r.o_orderstatus, false) AS o_orderstatus_differs,
       coalesce(l.o_totalprice <> r.o_totalprice, false) AS o_totalprice_differs
FROM copy_left l FULL OUTER JOIN copy_right r ON l.o_orderkey = r.o_orderkey"""

CTES["nearest_rates"] = r"""
SELECT p.currency, period, rate_to_vnd FROM (SELECT DISTINCT currency, period FROM cleaned_long WHERE regexp_matches(period, '^\d{4}-\d{2}$')) p
JOIN fx_rates ON p.currency = currency_code
QUALIFY row_number() OVER (PARTITION BY p.currency, period ORDER BY abs(date_diff('day', CAST(period || '-01' AS DATE), CAST(effective_date AS DATE))), effective_date) = 1"""
_EVENT_STATE = "event_type || '/' || band"
CTES["event_states"] = """
SELECT user_id, ts, event_id, event_type, CASE WHEN value >= 50 THEN 'HIGH' ELSE 'LOW' END AS band, json_extract_string(props, '$.k') AS k
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1"""
CTES["event_changes"] = f"""
SELECT * FROM (SELECT *, lag({_EVENT_STATE}) OVER w AS before, lag(band) OVER w AS band_before FROM event_states WINDOW w AS (PARTITION BY user_id ORDER BY ts))
WHERE before IS NULL OR before <> {_EVENT_STATE}"""


def _quality(table, key, rows, mandatory, orphan, numeric_detail="''", numeric_result="'PASSED'", extra=""):
    checks = f"""
SELECT 'silver_not_empty' AS check_name, '{table}' AS table_name, CASE WHEN count(*) = 0 THEN 'FAILED' ELSE 'PASSED' END AS result, count(*) AS row_count, '' AS details FROM {rows}
UNION ALL SELECT 'mandatory_columns', '{table}', CASE WHEN {mandatory} = '' THEN 'PASSED' ELSE 'FAILED' END, count(*), {mandatory} FROM {rows}
UNION ALL {orphan}
UNION ALL SELECT 'no_duplicates', '{table}', CASE WHEN bad > 0 THEN 'FAILED' ELSE 'PASSED' END, n, 'rows in repeated keys: ' || CAST(bad AS VARCHAR)
  FROM (SELECT CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS bad, CAST(sum(c) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM {rows} GROUP BY {key}))
UNION ALL SELECT 'no_ocr_typos', '{table}', {numeric_result}, count(*), {numeric_detail} FROM {rows}"""
    return checks + extra


def _orphans(table, column, rows):
    return f"""SELECT 'orphaned_flagged', '{table}', CASE WHEN count_if({column}) > 0 THEN 'WARNING' ELSE 'PASSED' END, count(*),
       'orphaned rows: ' || CAST(count_if({column}) AS VARCHAR) FROM {rows}"""


def _noted(column, flag):
    """Details and result of the cast check where every text that is no number is flagged."""
    return (
        f"CASE WHEN count_if({flag}) > 0 THEN '{column}: ' || CAST(count_if({flag}) AS VARCHAR) || ' flagged' ELSE '' END",
        f"CASE WHEN count_if({flag}) > 0 THEN 'WARNING' ELSE 'PASSED' END",
    )


def _given(*columns):
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c} has no value' END" for c in columns) + ")"


_RATIO = """
UNION ALL SELECT 'ratio_range', 'silver_kpi', CASE WHEN count_if(Unit = '%' AND actual_value > 1) > 0 THEN 'WARNING' ELSE 'PASSED' END, count(*),
       'ratios above one: ' || CAST(count_if(coalesce(Unit = '%' AND actual_value > 1, false)) AS VARCHAR) FROM silver_kpi_rows"""

CTES["quality"] = f"""
{_quality("silver_financial", "order_no, category, period", "silver_fin",
          _given("order_no", "category", "period", "amount_numeric", "currency"), _orphans("silver_financial", "IS_ORPHANED_ORDER", "silver_fin"),
          *_noted("amount", "IS_AMOUNT_UNPARSEABLE"))}
UNION ALL
{_quality("silver_kpi", KEY_LIST + ", PERIOD, SOURCE_FILE", "silver_kpi_rows", _given("KPI_Name", "PERIOD", "actual_value", "Unit"),
          _orphans("silver_kpi", "IS_ORPHANED", "silver_kpi_rows"), *_noted("unparsed_text", "IS_VALUE_UNPARSEABLE"), extra=_RATIO)}"""


def sql(final: str) -> str:
    """The statement with the building blocks it needs, in dependency order."""
    needed: list[str] = []

    def visit(text):
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "", text)):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    return (f"WITH {head}\n" if needed else "") + final.strip()


def _log(*rows):
    return "\nUNION ALL\n".join(rows)


def _change(keep, column, before, after, kind, source, file="SOURCE_FILE"):
    return f"""SELECT {keep}, {file} AS SOURCE_FILE, '{column}' AS COLUMN_NAME, CAST({before} AS VARCHAR) AS ORIGINAL_VALUE, CAST({after} AS VARCHAR) AS CORRECTED_VALUE,
       '{kind}' AS LOG_TYPE, '{RUN_TS}' AS LOGGED_AT FROM {source} WHERE coalesce({before}, '') <> coalesce({after}, '')"""


def _kpi_changes():
    rows = []
    for source, file, months in (("long_clean", LONG_KPI, LONG_VALUES), ("wide_clean", WIDE_KPI, MONTH_NAMES)):
        for c in [*months, *KPI_KEYS]:
            kind = "NORMALISE" if c in KPI_KEYS else "OCR_FIX"
            rows.append(_change("ROW_ID", c, q(f"_raw_{c}"), q(c), kind, source, f"'{file}'"))
    return _log(*rows)


_ISSUE = "order_no, category, period, SOURCE_FILE"
_LINE = "line_seq"

ORACLES = {
    "src_csv_roundtrip": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "json_pages_flatten": """SELECT CAST(o_orderkey // 500 AS VARCHAR) AS page, o_orderkey AS order_id, o_custkey AS customer_id, 'ORD-' || o_orderkey AS order_code,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS order_notes FROM orders""",
    "json_quarantine": sql(f"""SELECT 'GET /orders/headers' AS endpoint, page || '-again' AS request_page,
       raw_document, substr(raw_document, 1, 1000) AS raw_response,
       CASE kind WHEN 2 THEN 'MalformedJSON' WHEN 3 THEN 'EmptyResponse' ELSE 'ResponseFormat' END AS error_type,
       CASE kind WHEN 2 THEN 'document does not parse, no record taken' WHEN 3 THEN 'empty response' ELSE 'expected a list, or an object with a list under data' END AS error_message,
       '{RUN_TS}' AS ingestion_ts
FROM (SELECT *, CASE kind WHEN 2 THEN substr(list, 1, length(list) - 5) WHEN 3 THEN '  ' ELSE '{{"data":{{"page":' || page || '}}}}' END AS raw_document FROM order_pages) WHERE kind IN (2, 3, 4)"""),
    "page_chain": """WITH RECURSIVE numbers AS (SELECT DISTINCT o_orderkey // 10 AS n FROM orders),
pages AS (SELECT n, CASE WHEN n % 19 = 7 THEN n - 3 WHEN n < (SELECT max(n) FROM numbers) THEN n + 1 END AS nx FROM numbers WHERE n % 13 <> 5),
walk AS (SELECT n AS page, n AS here, 0 AS steps FROM pages
  UNION ALL SELECT page, nx, steps + 1 FROM walk JOIN pages ON here = n WHERE nx IN (SELECT n FROM pages) AND steps < 60),
ends AS (SELECT page, here, steps FROM walk JOIN pages ON here = n WHERE nx IS NULL OR nx NOT IN (SELECT n FROM pages)),
named AS (SELECT nx, count(*) AS c FROM pages WHERE nx IS NOT NULL GROUP BY nx)
SELECT 'p' || n AS page, 'p' || p.nx AS next_page, 1 + (n % 17 = 3)::BIGINT + (n % 23 = 9)::BIGINT AS copies, coalesce(c, 0)::BIGINT AS named_by,
       'p' || here AS end_page, steps::BIGINT AS steps_to_end,
       concat_ws(',', CASE WHEN n % 17 = 3 OR n % 23 = 9 THEN 'REPEATED' END, CASE WHEN n % 23 = 9 AND p.nx IS NOT NULL THEN 'DISAGREES' END,
                 CASE WHEN p.nx IS NOT NULL AND steps = 0 THEN 'GAP' END, CASE WHEN here IS NULL THEN 'LOOP' END, CASE WHEN c > 1 THEN 'SHARED' END,
                 CASE WHEN c IS NULL AND n <> 0 THEN 'STRAY' END) AS findings
FROM pages p LEFT JOIN ends ON page = n LEFT JOIN named ON named.nx = n""",
    "bronze_metadata": f"SELECT o_orderkey, o_orderstatus, 'orders.parquet' AS SOURCE_FILE, '{RUN_TS}' AS ingestion_timestamp FROM orders",
    "bronze_append": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate < DATE '1996-01-01' THEN '2024-01-31 06:00:00' ELSE '2024-02-07 06:00:00' END AS ingestion_timestamp,
       CASE WHEN o_orderdate < DATE '1996-01-01' THEN '2024-01-31' ELSE '2024-02-07' END AS ingestion_date FROM orders""",
    "upsert_latest": """WITH updates AS (
  SELECT o_orderkey + 1000 AS order_id, CASE WHEN o_orderstatus = 'P' THEN 'U' ELSE o_orderstatus END AS status,
         CAST(o_totalprice AS DECIMAL(18,4)) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS total FROM orders WHERE o_orderstatus <> 'F')
SELECT order_id, status, CAST(total AS DOUBLE) AS total FROM updates
UNION ALL SELECT o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS DOUBLE) FROM orders WHERE o_orderkey NOT IN (SELECT order_id FROM updates)""",
    "gold_partition_rebuild": """SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS period,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,4)) * CASE WHEN year(o_orderdate) = 1997 THEN 2 ELSE 1 END) AS DOUBLE) AS total,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders GROUP BY ALL""",
    "map_order_fields": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, 'ORD-' || o_orderkey AS order_code, CAST(NULL AS VARCHAR) AS order_notes FROM orders",
    "map_line_fields": """SELECT CAST(l_linenumber AS BIGINT) AS line_id, l_orderkey AS order_id, 'PART-' || l_partkey AS line_description,
       'supplier-' || l_suppkey || '@example.com' AS buyer_contact, l_quantity || ' x ' || l_shipdate AS line_notes FROM lineitem""",
    "unpivot_dates": sql("SELECT * FROM fin_wide_tall"),
    "unpivot_month_names": sql(_log(*[f"SELECT {KEY_LIST}, \"{n}\" AS actual_value, '{p}' AS PERIOD FROM kpi_wide" for p, n in zip(PERIODS, MONTH_NAMES)])),
    "unpivot_month_numbers": sql(_log(*[f"SELECT {KEY_LIST}, Target, M{m} AS actual_value, CAST(Year AS VARCHAR) || '-{m:02d}' AS PERIOD FROM kpi_long" for m in MONTHS])),
    "union_long_wide": sql("SELECT * FROM combined"),
    "ocr_fix": sql(f"SELECT order_no, line_seq, {ocr('amount')} AS amount FROM fin_dirty"),
    "normalize_text": sql(f"""SELECT order_no, line_seq, {initcap(squeeze('category'))} AS category, lower({squeeze('customer_name')}) AS customer_name,
       upper({squeeze('category')}) AS category_upper FROM fin_dirty"""),
    "period_parse": sql(f"SELECT order_no, line_seq, period AS period_raw, {period('period')} AS period FROM fin_dirty"),
    "amount_cast_flag": sql("SELECT order_no, line_seq, amount, CAST(amount_numeric AS DOUBLE) AS amount_numeric, IS_AMOUNT_UNPARSEABLE FROM cleaned_long"),
    "audit_log_changes": sql(_log(
        _change("order_no", "amount", "amount_raw", "amount_repaired", "OCR_FIX", "cleaned"),
        _change("order_no", "customer_name", "customer_name_raw", "customer_name", "CUSTOMER_NORM", "cleaned"),
    )),
    "kpi_change_log": sql(_kpi_changes()),
    "issue_log": sql(rf"""SELECT {_ISSUE}, 'PERIOD_PARSE_FAIL' AS LOG_TYPE, period_raw AS ORIGINAL_VALUE, CAST(NULL AS VARCHAR) AS CORRECTED_VALUE, 'not a known month format' AS DETAILS, '{RUN_TS}' AS LOGGED_AT
FROM cleaned WHERE period IS NULL OR (period = period_raw AND NOT regexp_matches(period, '^\d{{4}}-\d{{2}}$'))
UNION ALL SELECT {_ISSUE}, 'AMOUNT_NOT_NUMERIC', amount, NULL, 'no number after repair', '{RUN_TS}' FROM cleaned WHERE IS_AMOUNT_UNPARSEABLE"""),
    "sentinel_fill": sql(f"""SELECT Pillar, coalesce({squeeze('Sub_Pillar')}, 'UNKNOWN') AS Sub_Pillar, Department, KPI_Name, coalesce(Sub_KPI_Type, 'N/A') AS Sub_KPI_Type FROM kpi_long"""),
    "row_hash": sql(f"SELECT order_no, line_seq, {digest('order_no', 'category', 'customer_name', 'period', 'amount', 'currency')} AS ROW_HASH FROM fin_dirty"),
    "customer_canonical": sql("SELECT order_no, line_seq, customer_name_raw, customer_name, mapping_rule_id, normalization_status FROM cleaned_long"),
    "dedup_keep_highest": sql("""SELECT order_no, category, period, CAST(max(amount_numeric) AS DOUBLE) AS amount_numeric,
       coalesce(min(line_seq) FILTER (WHERE amount_numeric = top), min(line_seq)) AS line_seq
FROM (SELECT *, max(amount_numeric) OVER (PARTITION BY order_no, category, period) AS top FROM cleaned_long) GROUP BY order_no, category, period"""),
    "dedup_drop_log": sql("""SELECT order_no, category, period, amount, customer_name, line_seq FROM cleaned_long
QUALIFY row_number() OVER (PARTITION BY order_no, category, period ORDER BY amount_numeric DESC NULLS LAST, line_seq) > 1"""),
    "dedup_keep_first": sql("""SELECT order_no, category, first(period) AS period, currency, min(line_seq) AS line_seq
FROM cleaned_long GROUP BY order_no, category, coalesce(period, ''), currency"""),
    "dedup_repeat_log": sql(f"""SELECT 'DUPLICATE_DROP' AS LOG_TYPE, order_no, SOURCE_FILE, line_seq, 'ROW_LEVEL' AS COLUMN_NAME, CAST(NULL AS VARCHAR) AS ORIGINAL_VALUE,
       concat_ws(' || ', order_no, category, coalesce(period, ''), currency) AS CORRECTED_VALUE, 'repeats an earlier row after repair and normalisation' AS DETAILS, '{RUN_TS}' AS LOGGED_AT
FROM cleaned_long QUALIFY row_number() OVER (PARTITION BY order_no, category, coalesce(period, ''), currency ORDER BY line_seq) > 1"""),
    "dedup_summary": sql("""SELECT SOURCE_FILE, CAST(count_if(rn > 1) AS BIGINT) AS DROPPED_COUNT, CAST(count_if(rn = 1) AS BIGINT) AS KEPT_COUNT, 'DUPLICATE_SUMMARY' AS LOG_TYPE
FROM (SELECT SOURCE_FILE, row_number() OVER (PARTITION BY order_no, category, coalesce(period, ''), currency, coalesce(amount, '') ORDER BY line_seq NULLS LAST, amount_raw NULLS LAST) AS rn FROM cleaned)
GROUP BY SOURCE_FILE"""),
    "kpi_dedup_summary": sql(_log(*[f"""SELECT '{f}' AS SOURCE_FILE, (SELECT count(*) FROM {c}_clean) - (SELECT count(*) FROM {c}_once) AS DROPPED_COUNT,
       (SELECT count(*) FROM {c}_once) AS KEPT_COUNT, 'DUPLICATE_SUMMARY' AS LOG_TYPE""" for f, c in ((LONG_KPI, "long"), (WIDE_KPI, "wide"))])),
    "kpi_issue_log": sql(f"""SELECT {KEY_LIST}, PERIOD, SOURCE_FILE, 'VALUE_NOT_NUMERIC' AS LOG_TYPE, unparsed_text AS ORIGINAL_VALUE, CAST(NULL AS VARCHAR) AS CORRECTED_VALUE,
       'no number after repair' AS DETAILS, '{RUN_TS}' AS LOGGED_AT FROM kpi_issue_rows"""),
    "reconcile_drop_log": sql(f"""SELECT {KEY_LIST}, PERIOD, SOURCE_FILE, CAST(Target AS DOUBLE) AS Target, CAST(actual_value AS DOUBLE) AS actual_value,
       CASE WHEN place > 1 THEN 'SAME_VALUE_DROP' ELSE 'EMPTY_BESIDE_VALUE' END AS LOG_TYPE, '{RUN_TS}' AS LOGGED_AT
FROM kpi_ranked WHERE place > 1 OR (stated IS NULL AND all_given > 0)"""),
    "upsert_table": """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 10 = 3 THEN 'M' WHEN o_orderkey % 10 IN (4, 9) THEN 'X' ELSE o_orderstatus END AS status,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CASE WHEN o_orderkey % 10 = 3 THEN month(o_orderdate) % 12 + 1 ELSE month(o_orderdate) END AS INTEGER) AS month FROM orders""",
    "upsert_arrivals": """SELECT o_orderkey AS order_id, CASE o_orderkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN o_orderstatus ELSE 'S' END AS status,
       CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS BIGINT) AS load_batch, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(CASE WHEN o_orderkey % 4 = 0 THEN month(o_orderdate) % 12 + 1 ELSE month(o_orderdate) END AS INTEGER) AS month FROM orders""",
    "silver_write_log": sql("""SELECT * FROM quality WHERE table_name = 'silver_financial'
UNION ALL BY NAME SELECT unnest(['total_rows', 'orphaned_orders', 'fx_failed', 'unparseable_amounts']) AS check_name, 'silver_financial' AS table_name, 'COUNT' AS result,
       unnest([count(*), count_if(IS_ORPHANED_ORDER), count_if(IS_FX_CONVERSION_FAILED), count_if(IS_AMOUNT_UNPARSEABLE)])::BIGINT AS row_count, '' AS details FROM silver_fin"""),
    "as_of_versions": """WITH states AS (
  SELECT user_id, ts, event_type, CASE WHEN value >= 50 THEN 'HIGH' ELSE 'LOW' END AS band FROM events WHERE event_id % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
versions AS (SELECT * FROM states QUALIFY row(event_type, band) IS DISTINCT FROM lag(row(event_type, band)) OVER (PARTITION BY user_id ORDER BY ts))
SELECT event_id, e.user_id, v.event_type, v.band, epoch_us(v.ts) AS Valid_From FROM events e ASOF LEFT JOIN versions v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "customer_spellings": sql("SELECT DISTINCT customer_name, customer_name_raw, normalization_status, mapping_rule_id FROM cleaned_long"),
    "gold_load": sql("""SELECT 'dq_log' AS table_name, (SELECT count(*) FROM quality) AS row_count
UNION ALL SELECT 'gold_kpi_achievement', (SELECT count(*) FROM kpi_months)
UNION ALL SELECT 'gold_pillar_rollup', (SELECT count(*) FROM (SELECT DISTINCT PILLAR_ID, period FROM kpi_months WHERE NOT is_missing_actual))
UNION ALL SELECT 'gold_order_cost', (SELECT count(*) FROM (SELECT DISTINCT customer_name, period FROM silver_fin WHERE NOT IS_ORPHANED_ORDER))
UNION ALL SELECT 'gold_ytd', (SELECT count(*) FROM kpi_months WHERE actual_value IS NOT NULL)"""),
    "orders_pipeline": sql("""SELECT o_orderkey AS order_id, o_custkey AS customer_id, 'ORD-' || o_orderkey AS order_code, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS order_notes,
       CAST(0 AS BIGINT) AS line_part, coalesce(string_agg(l_linenumber || '/PART-' || l_partkey, ';' ORDER BY l_linenumber, 'PART-' || l_partkey) FILTER (WHERE l_orderkey IS NOT NULL), '') AS line_items,
       CAST(NULL AS VARCHAR) AS error_type, CAST(NULL AS VARCHAR) AS raw_document, CAST(NULL AS VARCHAR) AS endpoint
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, CASE kind WHEN 2 THEN 'MalformedJSON' WHEN 3 THEN 'EmptyResponse' ELSE 'ResponseFormat' END,
       CASE kind WHEN 2 THEN substr(list, 1, length(list) - 5) WHEN 3 THEN '  ' ELSE '{"data":{"page":' || page || '}}' END, 'GET /orders/headers'
FROM order_pages WHERE kind IN (2, 3, 4)"""),
    "reconcile_sources": sql(f"SELECT {KEY_LIST}, CAST(Target AS DOUBLE) AS Target, SOURCE_FILE, CAST(actual_value AS DOUBLE) AS actual_value, unparsed_text, PERIOD, IS_DUPLICATE, IS_CONFLICT, IS_VALUE_UNPARSEABLE FROM unified"),
    "reconcile_costs": sql("""SELECT order_no, category, currency, period, CAST(amount_numeric AS DOUBLE) AS amount_numeric, coalesce(low <> high, false) AS IS_CONFLICT, 'a b' AS Sub_Pillar, 'N/A' AS Sub_KPI_Type
FROM (SELECT *, min(amount_numeric) OVER grain AS low, max(amount_numeric) OVER grain AS high, count(amount_numeric) OVER grain AS given
      FROM (SELECT DISTINCT order_no, category, currency, period, amount_numeric FROM cleaned) WINDOW grain AS (PARTITION BY order_no, category, currency, period))
WHERE amount_numeric IS NOT NULL OR given = 0"""),
    "source_diff": sql("""SELECT * , CASE WHEN check_name IN ('row_count', 'sum:o_totalprice') THEN left_value = right_value ELSE left_value = 0 AND right_value = 0 END AS matches FROM (
SELECT 'row_count' AS check_name, CAST(sum(left_rows) AS DOUBLE) AS left_value, CAST(sum(right_rows) AS DOUBLE) AS right_value FROM copies
UNION ALL SELECT 'only_here', CAST(count_if(right_rows = 0) AS DOUBLE), CAST(count_if(left_rows = 0) AS DOUBLE) FROM copies
UNION ALL SELECT 'repeated_keys', 0, 0
UNION ALL SELECT 'differs:o_custkey', CAST(count_if(o_custkey_differs) AS DOUBLE), CAST(count_if(o_custkey_differs) AS DOUBLE) FROM copies
UNION ALL SELECT 'differs:o_orderstatus', CAST(count_if(o_orderstatus_differs) AS DOUBLE), CAST(count_if(o_orderstatus_differs) AS DOUBLE) FROM copies
UNION ALL SELECT 'differs:o_totalprice', CAST(count_if(o_totalprice_differs) AS DOUBLE), CAST(count_if(o_totalprice_differs) AS DOUBLE) FROM copies
UNION ALL SELECT 'differs:row', CAST(count_if(o_custkey_differs OR o_orderstatus_differs OR o_totalprice_differs) AS DOUBLE), CAST(count_if(o_custkey_differs OR o_orderstatus_differs OR o_totalprice_differs) AS DOUBLE) FROM copies
UNION ALL SELECT 'sum:o_totalprice', CAST((SELECT sum(o_totalprice) FROM copy_left) AS DOUBLE), CAST((SELECT sum(o_totalprice) FROM copy_right) AS DOUBLE))"""),
    "source_diff_keys": sql("SELECT o_orderkey, CAST(left_rows AS BIGINT) AS left_rows, CAST(right_rows AS BIGINT) AS right_rows, o_custkey_differs, o_orderstatus_differs, o_totalprice_differs FROM copies"),
    "source_diff_rows": """WITH l AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 1 AS s FROM orders),
r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey // 64 % 20 = 3 AND o_custkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, -1 AS s FROM orders
      WHERE NOT (o_orderkey // 64 % 20 = 7 AND o_custkey % 5 = 0))
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CASE WHEN sum(s) > 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, CAST(abs(sum(s)) AS BIGINT) AS copies
FROM (FROM l UNION ALL FROM r UNION ALL SELECT * FROM r WHERE o_orderkey // 64 % 20 = 11 AND o_custkey % 5 = 1)
GROUP BY ALL HAVING sum(s) <> 0""",
    "orphan_promotion": sql("""SELECT order_no, line_seq, amount, CASE WHEN parent <= came THEN 'MATCHED' WHEN parent IS NULL THEN 'ORPHANED' ELSE 'PROMOTED' END AS state,
       came AS arrived_in, CASE WHEN parent > came THEN parent END AS promoted_in
FROM (SELECT f.order_no, line_seq, amount, (CAST(substr(f.order_no, 5) AS BIGINT) + length(line_seq)) % 3 AS came,
             CASE WHEN e.order_no IS NOT NULL AND CAST(substr(f.order_no, 5) AS BIGINT) % 4 < 3 THEN CAST(substr(f.order_no, 5) AS BIGINT) % 4 END AS parent
      FROM fin_dirty f LEFT JOIN erp_orders e ON f.order_no = e.order_no)"""),
    "customer_review": """WITH known AS (SELECT c_custkey, lower(n_name) || ' ' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
names AS (SELECT DISTINCT CASE c_custkey % 6 WHEN 0 THEN k WHEN 1 THEN 'x' || k WHEN 2 THEN substr(k, 1, length(k) - 3) || 'z' || substr(k, length(k) - 1)
                 WHEN 3 THEN substr(k, 1, 1) || substr(k, 4) WHEN 4 THEN k || '-old' ELSE substr(k, 2) || 'q' END AS name FROM known),
pairs AS (SELECT name, k, levenshtein(name, k) AS edits FROM names JOIN (SELECT DISTINCT k FROM known) ON levenshtein(name, k) <= 2)
SELECT name, first(k ORDER BY edits, k) AS candidate, CAST(min(edits) AS INTEGER) AS edits, count(k) AS candidates
FROM names LEFT JOIN pairs USING (name) WHERE name NOT IN (SELECT k FROM known) GROUP BY name""",
    "fx_default_row": sql(f"""SELECT {sk('c.currency_code')} AS currency_sk, c.currency_code, CASE c.currency_code WHEN 'USD' THEN 'US Dollar' WHEN 'EUR' THEN 'Euro' ELSE 'Vietnamese Dong' END AS currency_name,
       CAST(rate AS DOUBLE) AS exchange_rate_to_vnd, n AS cost_lines
FROM latest c LEFT JOIN (SELECT currency, count(*) AS n FROM fin_dirty GROUP BY currency) ON currency = c.currency_code"""),
    "fx_convert": sql(f"""SELECT order_no, line_seq, currency, CAST(amount_numeric AS DOUBLE) AS amount_numeric, CAST({_CONVERTED} AS DOUBLE) AS converted_amount_vnd,
       {_CONVERTED} IS NULL AS IS_FX_CONVERSION_FAILED FROM cleaned_long LEFT JOIN latest ON currency = currency_code"""),
    "fx_asof": sql("""SELECT c.order_no, c.line_seq, c.currency, c.period, CASE WHEN c.currency = 'VND' THEN 1 ELSE CAST(n.rate_to_vnd AS DOUBLE) END AS rate_to_vnd
FROM cleaned_long c LEFT JOIN nearest_rates n ON c.currency = n.currency AND c.period = n.period"""),
    "orphan_flag": sql("SELECT f.order_no, line_seq, e.order_no IS NULL AS IS_ORPHANED_ORDER FROM fin_dirty f LEFT JOIN erp_orders e ON f.order_no = e.order_no"),
    "orphan_quarantine": sql("SELECT order_no, line_seq, amount FROM fin_dirty WHERE order_no NOT IN (SELECT order_no FROM erp_orders)"),
    "orders_nested_lines": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, 'ORD-' || o_orderkey AS order_code, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS order_notes,
       coalesce(l_linenumber // 10000, 0)::BIGINT AS line_part, count(l_orderkey) AS line_count, coalesce(string_agg(item, ';' ORDER BY l_linenumber, part, email, note) FILTER (WHERE l_orderkey IS NOT NULL), '') AS line_items
FROM orders LEFT JOIN (SELECT *, concat_ws('/', l_linenumber, part, email, note) AS item FROM (
  SELECT l_orderkey, l_linenumber, 'PART-' || l_partkey AS part, 'supplier-' || l_suppkey || '@example.com' AS email, l_quantity || ' x ' || l_shipdate AS note FROM lineitem)) ON l_orderkey = o_orderkey
GROUP BY ALL""",
    "kpi_master_match": sql(f"""SELECT m.PILLAR_ID, m.SP_ID, m.UA_ID, CAST(m.Yearly_Target AS DOUBLE) AS Yearly_Target, m.Aggregation_Method, {", ".join("u." + k for k in KPI_KEYS)}, u.PERIOD,
       CAST(u.actual_value AS DOUBLE) AS actual_value, u.SOURCE_FILE, m.Is_Active, m.Valid_From, m.Valid_To, m.Source_Version, m.UA_ID IS NULL AS IS_ORPHANED
FROM unified u LEFT JOIN master m ON {_MATCH}"""),
    "scd2_point_in_time": sql("""SELECT o_orderkey, f.UA_ID, PERIOD, CAST(Yearly_Target AS DOUBLE) AS Yearly_Target, Source_Version, Valid_From, Valid_To
FROM (SELECT o_orderkey, c_nationkey * 10 + CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'AUTOMOBILE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS UA_ID,
             CAST(year(o_orderdate) + 28 AS VARCHAR) || strftime(o_orderdate, '-%m') AS PERIOD FROM orders JOIN customer ON o_custkey = c_custkey) f
LEFT JOIN kpi_master v ON f.UA_ID = v.UA_ID AND PERIOD >= Valid_From AND PERIOD < Valid_To"""),
    "scd2_build": sql("""SELECT c.user_id, event_type, band, epoch_us(ts) AS Valid_From,
       coalesce(epoch_us(lead(ts) OVER (PARTITION BY c.user_id ORDER BY ts)), epoch_us(TIMESTAMP '9999-12-31 00:00:00')) AS Valid_To,
       lead(ts) OVER (PARTITION BY c.user_id ORDER BY ts) IS NULL AS is_current, before IS NOT NULL AND band <> band_before AS unit_changed, last_k
FROM event_changes c JOIN (SELECT user_id, k AS last_k FROM event_states QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) l ON c.user_id = l.user_id"""),
    "dim_kpi": sql(f"""SELECT {sk('UA_ID', 'Valid_From')} AS kpi_sk, UA_ID, CAST(Yearly_Target AS DOUBLE) AS Yearly_Target, Aggregation_Method, direction, Department, PILLAR_ID, Sub_Pillar, Valid_From,
       coalesce(lead(Valid_From) OVER (PARTITION BY UA_ID ORDER BY Valid_From), '9999-12') AS Valid_To,
       lead(Valid_From) OVER (PARTITION BY UA_ID ORDER BY Valid_From) IS NULL AS is_current, KPI_Name, Is_Active FROM kpi_master"""),
    "dim_date": """SELECT CAST(strftime(m, '%Y%m') AS INTEGER) AS date_sk, strftime(m, '%Y-%m') AS period_label, CAST(month(m) AS INTEGER) AS month, CAST(quarter(m) AS INTEGER) AS quarter, CAST(year(m) AS INTEGER) AS year
FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)""",
    "dim_customer": sql(f"""SELECT customer_name, min(customer_name_raw) AS customer_name_raw, count(DISTINCT customer_name_raw) AS spelling_count, min(normalization_status) AS normalization_status,
       min(mapping_rule_id) AS mapping_rule_id, {sk('customer_name')} AS customer_sk FROM cleaned_long GROUP BY customer_name"""),
    "dim_code_list": f"SELECT DISTINCT p_type AS fabric_type_code, {sk('p_type')} AS fabric_type_sk FROM part",
    "fact_order_cost": sql(f"""SELECT {sk('order_no', 'category', 'period')} AS fact_sk, order_no, category,
       CASE WHEN {canonical('period', 'year')} IS NOT NULL AND period BETWEEN lo AND hi THEN CAST(replace(period, '-', '') AS INTEGER) ELSE -1 END AS date_sk,
       {sk('customer_name')} AS customer_sk, CASE WHEN currency IN ('USD', 'EUR', 'VND') THEN {sk('currency')} ELSE -1 END AS currency_sk,
       CAST(-1 AS BIGINT) AS season_sk, CAST(-1 AS BIGINT) AS drop_sk, CAST(-1 AS BIGINT) AS fabric_type_sk,
       CAST(amount_numeric AS DOUBLE) AS amount_original, CAST(converted_amount_vnd AS DOUBLE) AS converted_amount_vnd, IS_ORPHANED_ORDER AS is_orphaned, '{RUN_TS}' AS ingestion_ts,
       {canonical('period', 'year')} AS year, {canonical('period', 'month')} AS month
FROM silver_fin, (SELECT strftime(min(l_shipdate), '%Y-%m') AS lo, strftime(max(l_shipdate), '%Y-%m') AS hi FROM lineitem)"""),
    "fact_kpi_actual": sql(f"""SELECT {sk('UA_ID', 'PERIOD', 'Unit')} AS fact_sk, {sk('UA_ID', 'Valid_From')} AS kpi_sk, CAST(replace(PERIOD, '-', '') AS INTEGER) AS date_sk, UA_ID, PERIOD, Unit AS unit,
       Aggregation_Method AS aggregation_method, CAST(actual_value AS DOUBLE) AS actual_value, CAST(Target AS DOUBLE) AS row_target, actual_value IS NULL AND NOT IS_VALUE_UNPARSEABLE AS is_missing_actual, IS_VALUE_UNPARSEABLE AS is_value_unparseable,
       IS_CONFLICT AS is_conflict, ROW_HASH,
       {canonical('PERIOD', 'year')} AS year, {canonical('PERIOD', 'month')} AS month FROM fact_kpi"""),
    "kpi_dynamic_agg": sql(f"""SELECT UA_ID, year, Unit, Aggregation_Method, n AS valid_months,
       CASE Aggregation_Method WHEN 'SUM' THEN CAST(total AS DOUBLE) WHEN 'LAST' THEN CAST(last_value AS DOUBLE) WHEN 'AVERAGE' THEN CASE WHEN n > 0 THEN {mean4('total', 'n')} END END AS aggregated_value
FROM (SELECT UA_ID, substr(PERIOD, 1, 4) AS year, Unit, Aggregation_Method, count(actual_value) AS n, sum(actual_value) AS total,
             arg_max(actual_value, PERIOD) FILTER (WHERE actual_value IS NOT NULL) AS last_value
      FROM fact_kpi GROUP BY ALL)"""),
    "kpi_month_spine": sql(f"""SELECT s.UA_ID, s.PERIOD, CAST(s.Yearly_Target AS DOUBLE) AS Yearly_Target, s.Valid_From, s.Valid_To, f.Unit AS unit, CAST(f.actual_value AS DOUBLE) AS actual_value,
       f.actual_value IS NULL AND NOT coalesce(f.IS_VALUE_UNPARSEABLE, false) AS is_missing_actual
FROM ({_spine("2022-07", "2030-02")}) s LEFT JOIN fact_kpi f ON s.UA_ID = f.UA_ID AND s.PERIOD = f.PERIOD"""),
    "achievement_pct": sql(f"""SELECT UA_ID, PERIOD, SOURCE_FILE, CAST(actual_value AS DOUBLE) AS actual_value, CAST(Yearly_Target AS DOUBLE) AS Yearly_Target, direction,
       {achieved('actual_value', 'Yearly_Target', 'direction')} AS achievement_pct, Yearly_Target = 0 AS zero_target_kpi,
       coalesce(direction = 'LOWER' AND actual_value = 0 AND Yearly_Target <> 0, false) AS zero_actual_lower FROM silver_kpi_rows WHERE NOT IS_ORPHANED"""),
    "achievement_dq_rows": sql("""SELECT UA_ID, period, CASE WHEN zero_target_kpi THEN 'ZERO_TARGET' ELSE 'ZERO_ACTUAL_LOWER_BETTER' END AS finding FROM kpi_months WHERE zero_target_kpi OR zero_actual_lower"""),
    "dq_results": sql("SELECT * FROM quality"),
    "dq_raw_costs": sql(_quality(
        "bronze_financial", "order_no, category, period", "fin_dirty", "'supplier_no is missing'",
        "SELECT 'orphaned_flagged', 'bronze_financial', 'FAILED', count(*), 'IS_ORPHANED is missing' FROM fin_dirty",
        f"'amount: ' || CAST(count_if(amount IS NOT NULL AND {amount('amount')} IS NULL) AS VARCHAR)", "'FAILED'")),
    "dq_null_counts": sql(_log(*[f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count({c}) AS non_null_count FROM cleaned_long"
                                 for c in ("order_no", "category", "period", "amount", "amount_numeric", "currency", "mapping_rule_id")])),
    "dq_gate": sql("SELECT count(*) AS checks, CAST(count_if(result = 'FAILED') AS BIGINT) AS failed, CAST(count_if(result = 'WARNING') AS BIGINT) AS warnings, CAST(count_if(result = 'FAILED') AS BIGINT) = 0 AS can_proceed FROM quality"),
    "run_summary": sql("SELECT count(*) AS total_rows, CAST(count_if(IS_ORPHANED_ORDER) AS BIGINT) AS orphaned_orders, CAST(count_if(IS_FX_CONVERSION_FAILED) AS BIGINT) AS fx_failed, CAST(count_if(IS_AMOUNT_UNPARSEABLE) AS BIGINT) AS unparseable_amounts FROM silver_fin"),
    "gold_order_cost": sql(f"""SELECT customer_name, period, CAST(sum(converted_amount_vnd) AS DOUBLE) AS total_cost_vnd, count(*) AS cost_lines, count_if(converted_amount_vnd IS NULL)::BIGINT AS unconverted_lines, {canonical('period', 'year')} AS year, {canonical('period', 'month')} AS month
FROM silver_fin WHERE NOT IS_ORPHANED_ORDER GROUP BY customer_name, period"""),
    "gold_kpi_achievement": sql("SELECT * REPLACE (CAST(actual_value AS DOUBLE) AS actual_value, CAST(target_value AS DOUBLE) AS target_value) FROM kpi_months"),
    "gold_pillar_rollup": sql("""SELECT PILLAR_ID, period, year, month, CASE WHEN n > 0 THEN CAST((2 * total + n) // (2 * n) AS DOUBLE) / 1000000 END AS mean_achievement, kpi_count, n AS rated_kpi_count
FROM (SELECT PILLAR_ID, period, year, month, sum(CAST(round(achievement_pct * 1000000) AS HUGEINT)) AS total, count(achievement_pct) AS n, count(*) AS kpi_count
      FROM kpi_months WHERE NOT is_missing_actual GROUP BY ALL)"""),
    "gold_ytd": sql(f"""SELECT UA_ID, PILLAR_ID, period, unit, aggregation_method, CAST(actual_value AS DOUBLE) AS actual_value,
       CASE aggregation_method WHEN 'SUM' THEN CAST(total AS DOUBLE) WHEN 'LAST' THEN CAST(actual_value AS DOUBLE) ELSE {mean4('total', 'n')} END AS ytd_actual, CAST(target_value AS DOUBLE) AS target_value, year, month
FROM (SELECT *, sum(actual_value) OVER w AS total, count(*) OVER w AS n FROM kpi_months WHERE actual_value IS NOT NULL WINDOW w AS (PARTITION BY UA_ID, year, unit, aggregation_method ORDER BY period))"""),
    "silver_financial": sql(f"""SELECT order_no, customer_name, category, period, amount, currency, CAST(amount_numeric AS DOUBLE) AS amount_numeric, IS_AMOUNT_UNPARSEABLE, IS_ORPHANED_ORDER, IS_DUPLICATE,
       CAST(converted_amount_vnd AS DOUBLE) AS converted_amount_vnd, IS_FX_CONVERSION_FAILED, SOURCE_FILE, '{RUN_TS}' AS INGESTION_TS FROM silver_fin"""),
    "silver_kpi": sql("SELECT * REPLACE (CAST(actual_value AS DOUBLE) AS actual_value, CAST(Target AS DOUBLE) AS Target, CAST(Yearly_Target AS DOUBLE) AS Yearly_Target) FROM silver_kpi_rows"),
}

# The same results by another way: kept up to date from changes instead of built from all.
ORACLES |= {"scd2_apply": ORACLES["scd2_build"], "gold_cost_incremental": ORACLES["gold_order_cost"], "gold_ytd_incremental": ORACLES["gold_ytd"]}
# The same result from tables in buckets.
ORACLES["orphan_flag_bucketed"] = ORACLES["orphan_flag"]


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
