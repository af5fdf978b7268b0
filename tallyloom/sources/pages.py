"""Landed API pages: JSON documents, a list or an envelope ``{"data": [...], "next_page": ...}``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: characters of a broken document that the error log shows.
SHOWN = 1000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file: its text and name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("document"), F.col("_metadata.file_name").alias("page")
    )


def landed_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of files that hold one document a line."""
    return spark.read.text(path).select(F.col("value").alias("document"))


def classify_pages(pages: DataFrame) -> DataFrame:
    """Parse each document once and name what is wrong with it, if anything.

    The whole document counts: one broken element makes it malformed and none
    of its records come through.
    """
    parsed = pages.withColumn("_doc", F.try_parse_json("document"))
    shape = F.schema_of_variant("_doc")
    body = F.try_variant_get("_doc", "$.data", "variant")
    is_list = shape.startswith("ARRAY")
    is_object = shape.startswith("OBJECT")
    data_shape = F.schema_of_variant(body)
    no_data = body.isNull() | (data_shape == "VOID")
    error = (
        F.when(F.coalesce(F.trim(F.regexp_replace("document", r"\s+", " ")), F.lit("")) == "", "EmptyResponse")
        .when(F.col("_doc").isNull(), "MalformedJSON")
        .when(is_list | (is_object & (no_data | data_shape.startswith("ARRAY"))), F.lit(None))
        .otherwise("ResponseFormat")
    )
    items = F.when(is_list, F.try_variant_get("_doc", "$", "array<variant>")).when(
        is_object & ~no_data, F.try_variant_get("_doc", "$.data", "array<variant>")
    )
    return parsed.select("*", error.alias("_error"), items.alias("_items")).drop("_doc")


def flatten_pages(pages: DataFrame) -> DataFrame:
    """All records of all well-formed pages, each as a variant; the pages form one feed.

    Broken pages have no item list, so ``explode`` passes over them. A filter on
    the error would be pushed down and parse every document again.
    """
    keep = [c for c in pages.columns if c != "document"]
    return classify_pages(pages).select(*keep, F.explode("_items").alias("record"))


def record_fields(records: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Named, typed fields of each record; ``fields`` maps target to (source, type). Absent is NULL."""
    keep = [c for c in records.columns if c != "record"]
    return records.select(
        *keep,
        *[F.try_variant_get("record", f"$.{source}", kind).alias(target) for target, (source, kind) in fields.items()],
    )


def raw_records(records: DataFrame) -> DataFrame:
    """The records as delivered, for the Bronze table."""
    keep = [c for c in records.columns if c != "record"]
    return records.select(*keep, F.to_json("record").alias("record_json"))


# Error types and what they mean.
ERROR_MESSAGES = {
    "EmptyResponse": "empty response",
    "MalformedJSON": "document does not parse, no record taken",
    "ResponseFormat": "expected a list, or an object with a list under data",
}


def quarantine_pages(pages: DataFrame, endpoint: str, run_ts: str, page: str = "page") -> DataFrame:
    """One error row per page that gave no records because it is broken.

    ``raw_document`` is the whole document, to be replayed; ``raw_response`` its beginning, to be read.
    """
    message = F.coalesce(*[F.when(F.col("_error") == k, F.lit(v)) for k, v in ERROR_MESSAGES.items()])
    broken = classify_pages(pages).select(
        page, "document", F.explode(F.array_compact(F.array("_error"))).alias("_error")
    )
    return (
        broken.select(
            F.lit(endpoint).alias("endpoint"),
            F.col(page).alias("request_page"),
            F.col("document").alias("raw_document"),
            F.substring("document", 1, SHOWN).alias("raw_response"),
            F.col("_error").alias("error_type"),
            message.alias("error_message"),
            F.lit(run_ts).cast("timestamp").alias("ingestion_ts"),
        )
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``page`` and ``next_page`` of each landed document; a bare list or a broken document names no next page."""
    return pages.select("page", F.try_variant_get(F.try_parse_json("document"), "$.next_page", "string").alias("next_page"))
