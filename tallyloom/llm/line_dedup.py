"""Line dedup: hash normalised lines, count documents per hash, drop repeated lines, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, row_tag, stage, table

BLANKS = " \t\n\x0b\x0c\r"
# A line that holds more than one of so many line rows is hot, so there are fewer hot lines than this.
HOT_SHARE = 10_000


def line_key(line: Column) -> Column:
    """The line without blanks at either end, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 2, min_length: int = 10) -> DataFrame:
    """Every row of `docs` as struct `row`, with n_lines, n_dropped and kept_text.

    A line goes when its key has at least `min_length` code points, at least `min_docs` different doc_id hold
    it, and its own doc_id is not the smallest of them. Defined results: a null or empty text is one empty
    line; a null doc_id neither counts as a document nor loses lines; rows that share a doc_id are one
    document; a text that loses all lines becomes empty. Other columns are carried inside `row`, whatever
    their names.

    The texts are cut into lines once, into a staged table. The shuffles carry hashes and positions; a text moves
    once, to meet the positions it loses. Documents per hash are counted in two steps that both combine before the
    shuffle, so a line in a third of all documents is a row per task. Rows of hot lines find their keeper by a
    broadcast of fewer than HOT_SHARE hashes, whatever the corpus, and are not shuffled by hash.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.withColumn("tag", row_tag(F.col("body")))
    lines = stage(
        rows.where("id is not null")
        .select("id", "tag", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
        .where(F.length("line") >= min_length)
        .select("id", "tag", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_length)
        .select("id", "tag", "pos", F.unhex(F.md5("key")).alias("hash")),
        "lines",
    )
    repeated = stage(
        lines.groupBy("hash", "id").agg(F.count("*").alias("rows"))
        .groupBy("hash").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.min("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("hash", "keeper", "rows"),
        "repeated",
    )
    is_hot = F.col("rows") * HOT_SHARE > lines.count()
    hot, cold = repeated.where(is_hot).select("hash", "keeper"), repeated.where(~is_hot).select("hash", "keeper")
    in_place = lines.join(F.broadcast(hot), "hash")
    moved = lines.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(cold, "hash")
    lost = in_place.unionByName(moved).where("id > keeper").groupBy("id", "tag").agg(F.collect_set("pos").alias("lost"))
    cut = rows.join(lost, ["id", "tag"], "left").select(
        "row", "body", "lost", F.when(F.col("lost").isNotNull(), F.split("body", "\n")).alias("lines")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    text = F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")
    return cut.select(
        "row",
        (F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("body")).otherwise(text).alias("kept_text"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > r.keeper, false) AS lost
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
