"""Benchmark decontamination: a broadcast hash set of test n-grams against all training token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import SEPARATORS, ascii_lower, row_tag, stage, table

WINDOW = 13
# Window hashes are broadcast up to this many bytes, at HASH_BYTES for each; beyond it positions and hashes meet in a shuffle.
BROADCAST_BYTES = 64 * 2**20
HASH_BYTES = 64


def split_words(text: Column) -> Column:
    """The words in their delivered case. The first or last entry is empty where the text starts or ends without a word."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def count_words(words: Column) -> Column:
    """How many entries of `split_words` are words."""
    outer = F.when(F.element_at(words, 1) == "", 1).otherwise(0) + F.when(F.element_at(words, -1) == "", 1).otherwise(0)
    return F.when(F.size(words) == 1, 1 - F.least(outer, F.lit(1))).otherwise(F.size(words) - outer).cast("long")


def window_hash(text: Column) -> Column:
    """Hash of a window's words. Equal words share their full lower case, so delivered and normalised words hash alike."""
    return F.xxhash64(F.lower(text))


def test_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, window (normalised words), n, hash, for every window of every item.

    An item with fewer than `width` words is one window; one without words has none.
    """
    words = F.filter(split_words(ascii_lower(F.col("text"))), lambda w: w != "")
    items = benchmark.select("item_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = items.select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.slice("w", F.col("s"), width).alias("w"))
    window = F.array_join("w", " ")
    return cut.select("item_id", window.alias("window"), F.size("w").alias("n"), window_hash(window).alias("hash"))


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """id, tag, start, n, window: every occurrence of a test window in a document, once for rows that are equal.

    The key is the whole n-gram: at each word of the whole text the words from there on, as many as a window
    has, are hashed and probed against the set of window hashes. A word that many windows share costs nothing
    more. `windows` is a staged table. Lengths are at most `width` numbers.

    Words themselves are never shuffled: the hashes are broadcast while their bound allows; beyond it position
    and hash alone go to the hashes, and the texts with hits meet their positions afterwards.
    """
    lengths = [r.n for r in windows.select("n").distinct().collect()] or [WINDOW]
    grams = windows.select("hash").distinct()
    words = docs.select(
        F.struct(F.col("doc_id").alias("id")).alias("id"), row_tag(F.coalesce("text", F.lit(""))).alias("tag"), split_words(F.col("text")).alias("w")
    )
    found = F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ")
    at = (
        words.select("id", "tag", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start"))
        .select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
        .where(F.col("start") + F.col("n") <= F.size("w"))
        .withColumn("hash", window_hash(found))
    )
    if grams.count() * HASH_BYTES <= BROADCAST_BYTES:
        seen = at.join(F.broadcast(grams), "hash").withColumn("found", ascii_lower(found)).drop("w")
    else:
        places = at.select("id", "tag", "start", "n", "hash").join(grams, "hash").distinct()
        seen = places.join(words, ["id", "tag"]).withColumn("found", ascii_lower(found)).drop("w")
    texts = windows.select("hash", F.col("window").alias("found")).distinct()
    return seen.join(texts, ["hash", "found"]).select("id", "tag", "start", "n", F.col("found").alias("window")).distinct()


def measure(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, tag, n_words, n_hit, n_items, items, contaminated: one row per row of `docs`.

    A word inside any occurrence of a window is hit; contaminated means n_hit > 0 and share * n_hit >= n_words.
    Defined results: a null text has no words; a null item text has no window; an item without id counts its
    words but is not listed; rows that share a doc_id are judged one by one; equal rows get equal results; a
    null doc_id is judged like any other. Other columns are not read. Hit words are counted as the length of a
    union of intervals in one running pass per document.
    """
    windows = stage(test_windows(benchmark, width), "windows")
    hits = stage(find_windows(docs, windows), "hits")
    order = Window.partitionBy("id", "tag").orderBy("start", "n", "window").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(order), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), reach))
    counted = hits.withColumn("fresh", fresh).groupBy("id", "tag").agg(F.sum("fresh").alias("n_hit"))
    of = windows.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item")).distinct()
    named = (
        hits.select("id", "tag", "window").distinct().join(of, "window").select("id", "tag", "item").distinct()
        .groupBy("id", "tag").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    rows = docs.select(
        "doc_id", F.struct(F.col("doc_id").alias("id")).alias("id"), row_tag(F.coalesce("text", F.lit(""))).alias("tag"),
        count_words(split_words(F.col("text"))).alias("n_words"),
    )
    out = rows.join(counted, ["id", "tag"], "left").join(named, ["id", "tag"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "tag", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """`docs` without the contaminated rows, all columns kept."""
    bad = measure(docs.select("doc_id", "text"), benchmark, width, share).where("contaminated")
    bad = bad.select(F.struct(F.col("doc_id").alias("id")).alias("id"), "tag").distinct()
    rows = docs.select(
        F.struct("*").alias("row"), F.struct(F.col("doc_id").alias("id")).alias("id"), row_tag(F.coalesce("text", F.lit(""))).alias("tag")
    )
    return rows.join(bad, ["id", "tag"], "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, tag, clean_text: the words of each text outside all hits, in their delivered case, joined by a space.

    For texts that should stay in part. Rows without a hit keep their text as it is.
    """
    windows = stage(test_windows(benchmark, width), "windows")
    hits = find_windows(docs, windows)
    covered = hits.groupBy("id", "tag").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))).alias("hit")
    )
    rows = docs.select(
        "doc_id", F.struct(F.col("doc_id").alias("id")).alias("id"), row_tag(F.coalesce("text", F.lit(""))).alias("tag"), "text"
    )
    w = split_words(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col("hit")), lambda i: w[i])
    clean = F.array_join(F.filter(kept, lambda x: x != ""), " ")
    return rows.join(covered, ["id", "tag"], "left").select(
        "doc_id", "tag", F.when(F.col("hit").isNull(), F.col("text")).otherwise(clean).alias("clean_text")
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS window
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)
), place AS (
  SELECT d.doc_id, s, n.n, array_to_string(d.w[s:s + n.n - 1], ' ') AS window
  FROM (SELECT DISTINCT n FROM win) n, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM doc) d
  WHERE s + n.n - 1 <= len(d.w)
), hit AS (
  SELECT p.doc_id, p.s, p.n, win.item_id FROM place p JOIN win ON win.window = p.window AND win.n = p.n
), word AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""
