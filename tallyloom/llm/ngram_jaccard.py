"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets of similarity t share at least t of the larger one, so, in any one order of all tokens, the first
n - ceil(t n) + l tokens of both hold l common ones, for every l. A longer prefix costs more list entries and
asks for more matches before a pair is verified; each document takes the l that its estimated candidates make
cheapest, and a pair must match as often as the smaller l of the two.

The order puts rare tokens first. All tokens of all documents are counted, in a table of fixed size: tokens
of one bucket share a count, so a token that many documents hold is never taken for a rare one. Any order
gives right results; the counts only keep long lists out of the prefixes.

Equal sets are one vertex. Vertices are linked in rounds. While long lists hold different components, each
round verifies chance neighbours of those lists, which is linear and joins a group of near copies without its
pairs. At the end all pairs that are left between different components are matched and verified, so no link
that matters is missed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_staged, release_memory, row_tag, small_batches, stage, table, worker_state
from tallyloom.llm.components import connected_components

# Most matches that a prefix may ask for.
MOST_MATCHES = 8
# Verifying a pair counts as so many list entries for each token of its sets.
VERIFY_COST = 0.5
# Other documents that a token of no special count is taken to have.
CHANCE = 0.25
# Token counts: buckets by the top bits of the hash, summed in chunks.
BUCKET_BITS = 24
CHUNK_BITS = 18
# A count as one byte: so many steps for each doubling.
STEPS = 8
# Lists of this many entries take part in the rounds of chance neighbours.
LONG_LIST = 16
# Prefixes of up to this many tokens go along with the entries of vertices in long lists.
HEAD = 64
# Keys of candidate texts are broadcast up to this many, else they meet the texts in a shuffle.
BROADCAST_KEYS = 4_000_000
REMEMBERED = 150_000


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a text with fewer words is one n-gram, one without words has none."""
    words = text.encode().lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    if not span:
        return h
    total = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - span + 1 + i])
    return np.unique(total)


def signed(h: np.ndarray) -> np.ndarray:
    """The same order as signed numbers."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set of that similarity."""
    return -(-percent * n // 100)


def count_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """A byte for each bucket: how many tokens of all documents fall into it, on a logarithmic scale.

    A task adds up its own documents and sends one compressed table; tables are summed chunk by chunk as they
    come. The driver gets 2**BUCKET_BITS bytes, whatever the size of the corpus.
    """
    buckets, chunk = 1 << BUCKET_BITS, 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = worker_state("word-hashes", WordHashes), np.zeros(buckets, np.uint32)
        for batch in batches:
            held = [shingle_set(t or "", width, hashes) >> np.uint64(64 - BUCKET_BITS) for t in batch.column("text").to_pylist()]
            np.add.at(total, np.concatenate([np.zeros(0, np.uint64), *held]), np.uint32(1))
        parts = [(i, zlib.compress(total[i * chunk : (i + 1) * chunk].tobytes(), 1)) for i in range(buckets // chunk) if total[i * chunk : (i + 1) * chunk].any()]
        del total
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(part), np.uint32)
                total[i] = total[i] + more if i in total else more.astype(np.uint64)
        logs = [np.minimum(255, np.round(STEPS * np.log2(1 + t.astype(np.float64)))).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(logs, pa.binary())], ["chunk", "logs"])

    parts = small_batches(docs.select("text")).mapInArrow(count, "chunk long, counts binary").repartition(buckets // chunk, "chunk")
    logs = np.zeros(buckets, np.uint8)
    for row in parts.mapInArrow(add, "chunk long, logs binary").collect():
        logs[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(row.logs, np.uint8)
    return logs


def choose_prefix(tokens: np.ndarray, logs: np.ndarray, usual: float, percent: int) -> tuple[int, np.ndarray]:
    """(matches, tokens): the prefix of the cheapest l under the order (count, hash).

    What a bucket counts above the usual is taken as the other documents of a token.
    """
    n = len(tokens)
    share = least_overlap(n, percent)
    longest = n - share + min(MOST_MATCHES, share)
    count = logs[tokens >> np.uint64(64 - BUCKET_BITS)]
    first = np.lexsort((tokens, count))[:longest]
    others = np.maximum(2.0 ** (count[first] / STEPS) - 1 - usual, 0.0) + CHANCE
    listed = np.cumsum(others)
    best = min(range(1, min(MOST_MATCHES, share) + 1), key=lambda l: listed[n - share + l - 1] * (1 + VERIFY_COST * n / l))
    return best, tokens[first[: n - share + best]]


def prefixes(docs: DataFrame, logs: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, tag, digest of the set, n, matches and prefix of each row."""
    of = docs.schema["doc_id"].dataType.simpleString()
    # What an average token of one document finds in its bucket beside itself.
    usual = float(np.mean(2.0 ** (logs / STEPS) - 1))
    held = docs.sparkSession.sparkContext.broadcast(logs)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("word-hashes", WordHashes)
        for batch in batches:
            found = [shingle_set(t or "", width, hashes) for t in batch.column("text").to_pylist()]
            chosen = [choose_prefix(s, held.value, usual, percent) if len(s) else (0, s) for s in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("tag"), pa.array([digest_of(s) for s in found], pa.binary()),
                pa.array([len(s) for s in found], pa.int64()), pa.array([m for m, _ in chosen], pa.int64()), _lists([signed(t) for _, t in chosen]),
            ], ["doc_id", "tag", "digest", "n", "matches", "prefix"])

    rows = docs.select("doc_id", row_tag(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    return small_batches(rows).mapInArrow(sets, f"doc_id {of}, tag long, digest binary, n long, matches long, prefix array<long>")


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def postings(vertices: DataFrame) -> DataFrame:
    """token, pos, vid, n, matches, size, rank, listed: the prefix entries of every vertex in lists of two or more.

    `size` is the length of a list. `rank` numbers such entries of a vertex by their place in the prefix, `listed` is how many it has. A token
    before a common one that no other prefix has is not in the other set at all, so ranks bound what two
    sets share so far.
    """
    entries = vertices.select(F.posexplode("prefix").alias("pos", "token"), "vid", "n", "matches")
    listed = entries.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    own = Window.partitionBy("vid")
    return entries.join(listed, "token").withColumns(
        {"rank": F.row_number().over(own.orderBy("pos")), "listed": F.count("*").over(own)}
    )


def close_sizes(percent: int) -> Column:
    """Whether sets of n_a and n_b tokens can be that similar."""
    return percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")


def can_overlap(before: Column, percent: int) -> Column:
    """Whether two sets can still be that similar, if up to the places pos_a and pos_b of their orders they share at most `before` tokens."""
    most = before + F.least(F.col("n_a") - 1 - F.col("pos_a"), F.col("n_b") - 1 - F.col("pos_b"))
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def verify(pairs: DataFrame, docs: DataFrame, vertices: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of vertices whose whole sets are similar enough, staged.

    Whole sets are made anew, for the texts of candidates only, and removed when they are compared.
    """
    ends = stage(pairs.select(F.col("a").alias("vid")).union(pairs.select("b")).distinct().join(vertices.select("vid", "tag", "digest"), "vid"), "ends")
    keys = ends.select("tag").distinct()
    keys = F.broadcast(keys) if ends.count() <= BROADCAST_KEYS else keys
    texts = docs.select(row_tag(F.coalesce("text", F.lit(""))).alias("tag"), "text").join(keys, "tag", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, given = worker_state("word-hashes", WordHashes), set()
        for batch in batches:
            found = {}
            for tag, text in zip(batch.column("tag").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if tag not in given:
                    given.add(tag)
                    s = shingle_set(text, width, hashes)
                    found[digest_of(s)] = signed(s)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), _lists(list(found.values()))], ["digest", "tokens"])

    # Sets are grouped by digest before they meet their vertices, so that both take one shuffle of the sets.
    made = small_batches(texts).mapInArrow(sets, "digest binary, tokens array<long>").groupBy("digest").agg(F.first("tokens").alias("tokens"))
    made = stage(made.join(ends.select("digest", "vid"), "digest").select("vid", "tokens"), "sets")
    both = pairs.join(made.select(F.col("vid").alias("b"), F.col("tokens").alias("tb")), "b")
    both = both.join(made.select(F.col("vid").alias("a"), F.col("tokens").alias("ta")), "a")
    common = F.size(F.array_intersect("ta", "tb"))
    found = stage(both.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b"), "links")
    drop_staged(ends, made)
    return found


def link(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, tag, row, n_shingles, component_id of every row of `docs`, staged.

    Defined results: a text without words, or null, is linked with nothing; rows that share a doc_id are texts
    of their own; a null doc_id takes part and is never a component_id unless no other is there; repeated rows
    are equal texts. component_id is the smallest doc_id reachable by links. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    logs = count_tokens(docs, width)
    sets = stage(prefixes(docs, logs, width, percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    first = F.min(F.struct("row", "tag", "n", "matches", "prefix")).alias("first")
    vertices = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), first)
    vertices = stage(vertices.select("digest", "least_id", F.col("first.row").alias("vid"), "first.tag", "first.n", "first.matches", "first.prefix"), "vertices")
    # Prefixes live on in the vertices only.
    rows = stage(sets.select("doc_id", "tag", "row", "digest", F.col("n").alias("n_shingles")), "rows")
    drop_staged(sets)
    lists = stage(postings(vertices), "postings")

    tried = _neighbours(lists.withColumn("component", F.col("vid")), 0, percent)
    links = verify(tried, docs, vertices, width, percent)
    part = connected_components(links)
    # A round of which less than a tenth is linked has found what chance finds.
    gain, turn = 10 * links.count() >= tried.count(), 1
    while gain:
        within, entries, across = _mixed(lists.where(F.col("size") >= LONG_LIST), part)
        if across <= entries:
            break
        tried = _neighbours(within, turn, percent)
        new = verify(tried, docs, vertices, width, percent)
        gain, turn = 10 * new.count() >= tried.count(), turn + 1
        links = links.union(new)
        part = connected_components(links)
        drop_staged(within)
    within, _, _ = _mixed(lists, part)
    pairs = _across(within, vertices, percent)
    more = verify(pairs, docs, vertices, width, percent)
    drop_staged(lists, within, pairs)

    part = connected_components(links.union(more))
    of = vertices.join(part.withColumnRenamed("id", "vid"), "vid", "left").select("digest", "least_id", F.coalesce("component", "vid").alias("component"))
    named = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = of.join(named, "component").select("digest", "component", "component_id")
    linked = stage(
        rows.join(of, "digest", "left").select(
            "doc_id", "tag", "row", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
        ),
        "linked",
    )
    drop_staged(rows, vertices)
    return linked


def _mixed(lists: DataFrame, part: DataFrame) -> tuple[DataFrame, int, float]:
    """The lists that hold different components, with `component`; their entries, and their pairs of different components."""
    within = lists.join(part.withColumnRenamed("id", "vid"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    own = within.groupBy("token", "component").agg(F.count("*").alias("k"))
    mixed = own.groupBy("token").agg(F.sum("k").alias("total"), F.sum(F.col("k") * F.col("k")).alias("inside")).where("total * total > inside")
    mixed = stage(mixed, "mixed-tokens")
    entries, across = mixed.agg(F.sum("total"), F.sum((F.col("total") * F.col("total") - F.col("inside")) / 2)).first()
    return stage(within.join(mixed.select("token"), "token", "left_semi"), "mixed"), entries or 0, across or 0


def _neighbours(within: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of different components that stand side by side in lists.

    In the first turn all lists have the same order, so that near copies are neighbours in most of their
    lists, and pairs must be it as often as they need matches. Later turns take long lists only, each in an
    order by chance of its own. Lists are cut into runs, so that no task holds a list.
    """
    chance = F.xxhash64("vid", F.lit(turn)) if not turn else F.xxhash64("vid", "token", F.lit(turn))
    runs = within.where(F.col("size") >= (LONG_LIST if turn else 2)).withColumn("chance", chance)
    runs = runs.withColumn("run", F.pmod("chance", F.ceil(F.col("size") / 256)))
    order = Window.partitionBy("token", "run").orderBy(*(["chance"] if turn else ["n"]), "vid")
    after = F.lead(F.struct("vid", "n", "component", "pos", "rank", "matches")).over(order)
    pairs = runs.withColumn("next", after).where("next is not null and component <> next.component")
    pairs = pairs.select(
        F.least("vid", "next.vid").alias("a"), F.greatest("vid", "next.vid").alias("b"),
        F.col("n").alias("n_a"), F.col("next.n").alias("n_b"), F.col("pos").alias("pos_a"), F.col("next.pos").alias("pos_b"),
        F.least("rank", "next.rank").alias("shared"), F.least("matches", "next.matches").alias("need"),
    )
    pairs = pairs.where(close_sizes(percent) & can_overlap(F.col("shared"), percent)).groupBy("a", "b").agg(
        F.count("*").alias("common"), F.first("need").alias("need")
    )
    return stage((pairs if turn else pairs.where("common >= need")).select("a", "b"), "candidates")


def _across(within: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components with as many common prefix tokens as they need, and room for enough others.

    A vertex in a long list brings its prefix along, if that is short: two of them are matched on the spot, and
    the pair passes once, at its first common token. Other pairs are counted over the lists.
    """
    crowded = within.where(F.col("size") >= LONG_LIST).select("vid").distinct()
    heads = vertices.where(F.size("prefix") <= HEAD).join(crowded, "vid", "left_semi").select("vid", F.col("prefix").alias("head"))
    rows = within.join(heads, "vid", "left")
    side = lambda x: rows.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("vid", "n", "matches", "component", "pos", "rank", "listed", "head")))
    need, common = F.least("matches_a", "matches_b"), F.array_intersect("head_a", "head_b")
    whole = F.col("head_a").isNotNull() & F.col("head_b").isNotNull()
    # The first common token has the needed matches behind it, and nothing common before it.
    early = (F.col("rank_a") <= F.col("listed_a") - need + 1) & (F.col("rank_b") <= F.col("listed_b") - need + 1) & can_overlap(F.lit(1), percent)
    once = early & (F.get(common, F.lit(0)) == F.col("token")) & (F.size(common) >= need) & _room(common, "head_a", "head_b", percent)
    pairs = side("a").join(side("b"), "token").where(
        (F.col("vid_a") < F.col("vid_b")) & (F.col("component_a") != F.col("component_b")) & close_sizes(percent)
        & (F.least("listed_a", "listed_b") >= need) & can_overlap(F.least("rank_a", "rank_b"), percent) & F.when(whole, once).otherwise(True)
    ).select("vid_a", "vid_b", "n_a", "n_b", need.alias("need"), whole.alias("whole"), "pos_a", "pos_b")
    counted = pairs.groupBy(F.col("vid_a").alias("a"), F.col("vid_b").alias("b"), "n_a", "n_b", "need", "whole").agg(
        F.count("*").alias("common"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b")
    )
    # A token left out by its place shows that its pair is not similar, so counts that matter are whole.
    passed = F.col("whole") | ((F.col("common") >= F.col("need")) & can_overlap(F.col("common"), percent))
    return stage(counted.where(passed).select("a", "b"), "candidates")


def _room(common: Column, a: str, b: str, percent: int) -> Column:
    """Whether the tokens behind the last common one leave two sets similar enough."""
    last = F.get(common, F.size(common) - 1)
    behind = F.least(F.col("n_a") - F.array_position(F.col(a), last), F.col("n_b") - F.array_position(F.col(b), last))
    most = F.size(common) + behind
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component, that of the smallest doc_id; rows without words all stay."""
    linked = link(docs, width, percent)
    best = linked.where("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    ).select(F.col("best.row").alias("row"), F.lit(True).alias("best"))
    judged = linked.join(best, "row", "left").select(F.struct("doc_id").alias("id"), "tag", F.coalesce("best", F.col("component").isNull()).alias("stays"))
    # Rows of one doc_id and text are equal here; how many of them stay is counted, not which.
    fate = judged.groupBy("id", "tag").agg(F.count("*").alias("there"), F.count(F.when(F.col("stays"), 1)).alias("stay"))
    gone = fate.where("stay = 0").select("id", "tag")
    some = fate.where("stay > 0 and stay < there").select("id", "tag")
    rows = docs.select(F.struct("*").alias("whole"), F.struct("doc_id").alias("id"), row_tag(F.coalesce("text", F.lit(""))).alias("tag"))
    rows = rows.join(gone, ["id", "tag"], "left_anti")
    single = rows.join(some, ["id", "tag"], "left_anti").select("whole")
    repeated = rows.join(some, ["id", "tag"], "left_semi").groupBy("id", "tag").agg(F.first("whole").alias("whole")).select("whole")
    return single.union(repeated).select("whole.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), token AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM words WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM token GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM token a JOIN token b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
