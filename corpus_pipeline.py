"""A corpus from raw documents to packed sequences, in five stages of tallyloom.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
`docs`, but for the last one, which returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_staged, stage, table
from tallyloom.llm.decontaminate import remove_contaminated
from tallyloom.llm.line_dedup import BLANKS, drop_repeated_lines
from tallyloom.llm.ngram_jaccard import keep_one
from tallyloom.llm.packing import pack
from tallyloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; the scores are learnt from the labels of rows that are here."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines, and without the rows whose every word stood in lines that others keep; n_chars follows the text."""
    emptied = (F.col("n_dropped") > 0) & (F.trim("kept_text", F.lit(BLANKS)) == "")
    cleaned = drop_repeated_lines(docs).where(~emptied)
    new = {"text": F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept_text"))}
    new["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text")) if "n_chars" in docs.columns else None
    kinds = dict(docs.dtypes)
    return cleaned.select(
        *(new[c].cast(kinds[c]).alias(c) if new.get(c) is not None else F.col("row").getField(c).alias(c) for c in docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8."""
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark windows cover a twentieth or more."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Learnt scores are not expressible in SQL; tests/llm holds all rows of run() against brute force, the scores as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
