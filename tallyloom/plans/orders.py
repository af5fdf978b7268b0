"""ERP orders: landed pages to Bronze records and nested Silver orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyloom.operators.orders import HEADER_FIELDS, LINE_FIELDS, nest_lines
from tallyloom.sources.pages import flatten_pages, quarantine_pages, raw_records, record_fields

NUMERIC_IDS = {"id", "userId", "postId"}


def _typed(fields: dict[str, str]) -> dict[str, tuple[str, str]]:
    return {target: (source, "bigint" if source in NUMERIC_IDS else "string") for source, target in fields.items()}


@dataclass(frozen=True)
class OrderTables:
    bronze_headers: DataFrame
    bronze_lines: DataFrame
    orders: DataFrame
    errors: DataFrame


def order_tables(header_pages: DataFrame, line_pages: DataFrame, run_ts: str) -> OrderTables:
    """Everything one delivery of pages yields; write the Bronze frames before using ``orders``."""
    header_records, line_records = flatten_pages(header_pages), flatten_pages(line_pages)
    headers = record_fields(header_records, _typed(HEADER_FIELDS)).select(*HEADER_FIELDS.values())
    lines = record_fields(line_records, _typed(LINE_FIELDS)).select(*LINE_FIELDS.values())
    errors = quarantine_pages(header_pages, "GET /orders/headers", run_ts).unionByName(
        quarantine_pages(line_pages, "GET /orders/lines", run_ts)
    )
    return OrderTables(raw_records(header_records), raw_records(line_records), nest_lines(headers, lines), errors)
