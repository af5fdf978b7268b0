"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both token sequences of a document tile the same bytes. `merge_asof`, keyed by document, gives each token start
the token of the other side that covers it; the union of both directions is every overlap. Where two tokens
start together their predecessors end together, so these places cut the document into groups.

How often an id pair is linked in the whole corpus is counted per batch of documents first, then per pair. A
batch keeps, for each of its pairs, the documents that hold it; these lists meet the corpus-wide counts by
pair and return to their batch, so neither tokens nor links are ever shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_staged, stage, table, worker_state
from tallyloom.llm.token_counts import byte_alphabet

# Pre-tokens of the byte-level vocabulary (fixed value of the contract's tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts with a longer run go through the tokenizer whose time does not grow with the square of it.
LONG_RUN = re.compile(r"\S{4096}|\s{4096}")
# Documents are aligned together until they hold so many bytes.
BATCH_BYTES = 4 << 20


class ByteLevel:
    """Side A: ids of a byte-level BPE vocabulary, special strings as plain text, and the bytes of each id."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            self.slow.encode(t, add_special_tokens=False).ids if LONG_RUN.search(t) else self.fast.encode_ordinary(t) for t in texts
        ]


class Pieces:
    """Side B: ids of a piece model, and the bytes of each id."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_of = [self.piece_bytes(i) for i in range(self.model.get_piece_size())]

    def piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def place(ids: list[list[int]], sizes: np.ndarray) -> pd.DataFrame:
    """A row per token: its document's number, its place in the bytes of all documents one behind another, its id."""
    token = np.concatenate([np.zeros(0, np.int64), *(np.array(i, np.int64) for i in ids)])
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), [len(i) for i in ids])
    return pd.DataFrame({"doc": doc, "at": np.cumsum(sizes[token]) - sizes[token], "id": token, "row": np.arange(len(token))})


def align(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of A and of B that are linked, and for the tokens of A and of B whether a group starts there."""
    in_b = pd.merge_asof(a[["doc", "at"]], b[["doc", "at", "row"]], on="at", by="doc")["row"].to_numpy(np.int64)
    in_a = pd.merge_asof(b[["doc", "at"]], a[["doc", "at", "row"]], on="at", by="doc")["row"].to_numpy(np.int64)
    a_at, b_at = a["at"].to_numpy(), b["at"].to_numpy()
    starts_a, starts_b = a_at == b_at[in_b], b_at == a_at[in_a]
    # A pair that starts together is found from both sides and counts once.
    left = np.concatenate([a["row"].to_numpy(), in_a[~starts_b]])
    right = np.concatenate([in_b, b["row"].to_numpy()[~starts_b]])
    return left, right, starts_a, starts_b


class GroupWriter:
    """Digests of `a1,a2|b1;a3|b2,b3`, from tables of every id with every separator behind it."""

    SEPARATORS = (b",", b"|", b";", b"")

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.total = n_a, n_a + n_b
        shown = [b"%d" % i for i in [*range(n_a), *range(n_b)]]
        self.written = np.array([s + end for end in self.SEPARATORS for s in shown], object)

    def digests(self, a: pd.DataFrame, b: pd.DataFrame, starts_a: np.ndarray, starts_b: np.ndarray, n_docs: int) -> list[str]:
        group_a, group_b = np.cumsum(starts_a) - 1, np.cumsum(starts_b) - 1
        n_groups = int(starts_a.sum())
        # Tokens in order of group, then side: behind a token of A come all B tokens of its earlier groups, and so on.
        b_before = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
        a_until = np.cumsum(np.bincount(group_a, minlength=n_groups))
        order = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + b_before[group_a], np.arange(len(b)) + a_until[group_b]
        order[at_a], order[at_b] = a["id"].to_numpy(), b["id"].to_numpy() + self.n_a
        # What stands behind each token: a comma inside a side, a bar behind the last of A, a semicolon behind a group.
        end = np.zeros(len(order), np.int64)
        end[at_a[np.append(np.flatnonzero(starts_a)[1:] - 1, len(a) - 1)]] = 1
        end[at_b[np.append(np.flatnonzero(starts_b)[1:] - 1, len(b) - 1)]] = 2
        doc = np.empty(len(order), np.int64)
        doc[at_a], doc[at_b] = a["doc"].to_numpy(), b["doc"].to_numpy()
        last = np.append(np.flatnonzero(np.diff(doc)), len(doc) - 1)
        end[last] = 3
        written = self.written[end * self.total + order]
        out, start = [""] * n_docs, 0
        for stop in last + 1:
            out[doc[start]] = hashlib.sha256(b"".join(written[start:stop])).hexdigest()
            start = stop
        return out


ROWS = "batch long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long, holders binary"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Rows of one batch of texts: one per document, one per id pair."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.sizes = [np.array([len(t) for t in side.bytes_of], np.int64) for side in (self.a, self.b)]
        self.writer = GroupWriter(len(self.a.bytes_of), len(self.b.bytes_of))

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the bytes of a side are not those of a space and the text."""
        full = [f" {t}" for t in texts]
        left, right = self.a.encode(full), self.b.encode(texts)
        for i, text in enumerate(full):
            raw = text.encode()
            if len(raw) == 1 or any(b"".join([side.bytes_of[t] for t in ids[i]]) != raw for side, ids in ((self.a, left), (self.b, right))):
                left[i], right[i] = [], []
        return left, right

    def columns(self, texts: list[str]) -> tuple[dict[str, np.ndarray | list], dict[str, np.ndarray | list]]:
        n = len(texts)
        ids_a, ids_b = self.tokens(texts)
        a, b = place(ids_a, self.sizes[0]), place(ids_b, self.sizes[1])
        per_doc = {"n_a": np.array([len(i) for i in ids_a]), "n_b": np.array([len(i) for i in ids_b])}
        if not len(a):
            zeros = np.zeros(n, np.int64)
            return per_doc | {"n_groups": zeros, "n_links": zeros, "groups_sha256": [""] * n}, {"pair": [], "n": [], "holders": []}
        left, right, starts_a, starts_b = align(a, b)
        doc_a, id_a, id_b = a["doc"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy()
        per_doc["n_groups"] = np.bincount(doc_a[starts_a], minlength=n)
        per_doc["n_links"] = np.bincount(doc_a[left], minlength=n)
        per_doc["groups_sha256"] = self.writer.digests(a, b, starts_a, starts_b, n)
        # Pair and document in one number, so that one sort counts both and leaves the holders of a pair together.
        wide = len(self.b.bytes_of)
        held, times = np.unique((id_a[left] * wide + id_b[right]) * n + doc_a[left], return_counts=True)
        pair, first = np.unique(held // n, return_index=True)
        holders = np.stack([held % n, times], axis=1).astype("<u4")
        cut = np.append(first, len(held))
        per_pair = {
            "pair": pair, "n": np.add.reduceat(times, first),
            "holders": [holders[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)],
        }
        return per_doc, per_pair


def align_batches(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of all batches: with doc_id and its place in the batch for a document, with pair, n and holders for a pair."""
    of = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_state(f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        number = TaskContext.get().partitionId() << 32
        for ids, texts in cut_by_bytes(batches):
            per_doc, per_pair = aligner.columns(texts)
            n, m = len(texts), len(per_pair["pair"])
            columns = [pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.array(np.full(n + m, number), pa.int64())]
            columns.append(pa.concat_arrays([pa.array(range(n), pa.int32()), pa.nulls(m, pa.int32())]))
            columns += [pa.concat_arrays([pa.array(per_doc[c], pa.int64()), pa.nulls(m, pa.int64())]) for c in COUNTS]
            columns.append(pa.concat_arrays([pa.array(per_doc["groups_sha256"], pa.string()), pa.nulls(m, pa.string())]))
            kinds = {"pair": pa.int64(), "n": pa.int64(), "holders": pa.binary()}
            columns += [pa.concat_arrays([pa.nulls(n, kind), pa.array(per_pair[c], kind)]) for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[c.split(" ")[0] for c in ROWS.split(", ")]])
            number += 1

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {of}, {ROWS}")


def cut_by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Documents together up to BATCH_BYTES, at least one."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            if texts and size + len(text) > BATCH_BYTES:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
            ids.append(batch.column("doc_id").slice(i, 1))
            texts.append(text)
            size += len(text)
    if texts:
        yield pa.concat_arrays(ids), texts


def sum_in_batch(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Per document of a batch: links whose pair is the best of its B id, and the sum of the counts of all links."""
    held = np.frombuffer(b"".join(rows["holders"]), "<u4").reshape(-1, 2).astype(np.int64)
    own = np.repeat(np.arange(len(rows)), rows["holders"].str.len() // 8)
    n = int(held[:, 0].max()) + 1
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(total, held[:, 0], held[:, 1] * rows["total"].to_numpy()[own])
    np.add.at(best, held[:, 0], held[:, 1] * rows["is_best"].to_numpy(np.int64)[own])
    return pd.DataFrame({"batch": rows["batch"].iloc[0], "place": np.arange(n), "n_best": best, "count_sum": total})


def pair_totals(pairs: DataFrame, b_id: Column) -> DataFrame:
    """pair, total: links of the whole corpus; is_best: no other pair of the B id has more."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    best = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("highest"))
    # One row per id of vocabulary B.
    return totals.withColumn("b_id", b_id).join(F.broadcast(best), "b_id").select("pair", "total", (F.col("total") == F.col("highest")).alias("is_best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Defined results: a null or empty text, and one that a tokenizer does not give back byte by byte, has zeros and
    an empty groups_sha256 and counts for no pair; each row is a document of its own, repeated and null doc_id
    included; other columns are not read; an empty table gives no rows. Pairs that tie for the highest count of
    their B id are all best.
    """
    pieces = _pieces(b_path)
    rows = stage(align_batches(docs, a_path, b_path), "aligned")
    pairs = rows.where("pair is not null").select("batch", "pair", "n", "holders")
    totals = stage(pair_totals(pairs, F.col("pair") % pieces), "pair-totals")
    weighed = pairs.select("batch", "pair", "holders").join(totals, "pair").select("batch", "holders", "total", "is_best")
    sums = weighed.groupBy("batch").applyInPandas(sum_in_batch, "batch long, place int, n_best long, count_sum long")
    found = rows.where("place is not null").join(sums, ["batch", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = stage(found.select("doc_id", *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256"), "alignment")
    drop_staged(rows, totals)
    return out


@functools.cache
def _pieces(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
