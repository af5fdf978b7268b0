"""Harmonic packing: pieces of reciprocal-capacity lengths fill bins of a fixed number of pieces, each worker on its own.

Class i holds pieces of exactly capacity / 2**i tokens, and 2**i of them fill a sequence without padding. A
document is cut into as many whole sequences as it fills, and its rest into the classes of its binary digits.
Workers number the pieces of a class among their own; one running sum of the counts per worker turns those
numbers into places, so pieces never move to be packed. What is left of a class at the end goes into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches, stage, table, worker_state
from tallyloom.llm.token_counts import byte_alphabet

CAPACITY = 4096
# Words of the pre-tokenizer after normalising, and the id that ends a document (fixed values of the contract).
# White space is what Unicode calls so: the separators U+001C to U+001F are not.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"\p{{L}}+|'(?:[stmd]|re|ve|ll)|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
# The same words of a text in small ASCII.
ASCII_WORD = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r a-z0-9]+")
END_ID = 2
# Distinct words that a worker remembers before it starts anew.
REMEMBERED = 500_000


class WordEncoder:
    """Ids of whole texts, each distinct word encoded once by the tokenizer and then looked up.

    Only vocabularies that encode words independently, after NFC and lower case, fit this. Texts that hold a
    special string go to the tokenizer whole, and so do texts with code points that Unicode as Python has it does
    not assign yet, of which the libraries' tables may say different things.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The vocabulary's own merges on one word, without the normalising and cutting that is done here for whole texts.
        self.model = self.tokenizer.model
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.known: dict[str, bytes] = {}
        # Characters met so far that Unicode assigns; at most as many as there are.
        self.assigned: set[str] = set()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return self.whole(text)
        original = text
        if text.isascii():
            words = ASCII_WORD.findall(text.lower())
        else:
            # The tokenizer lowers each letter by itself; a capital sigma has no final form there.
            words = WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = set(words)
            for word in new:
                plain = word.isascii()
                if not plain and not self.assigned.issuperset(word):
                    if any(unicodedata.category(c) == "Cn" for c in word):
                        return self.whole(original)
                    self.assigned.update(word)
                shown = word if plain and word.isprintable() else "".join([self.shown[b] for b in word.encode()])
                known[word] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return b"".join([known[w] for w in words])


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, then the binary digits of the rest, largest first."""
    pieces = [(start, capacity) for start in range(0, n - capacity + 1, capacity)]
    start = len(pieces) * capacity
    size = capacity
    while start < n:
        size //= 2
        if n - start >= size:
            pieces.append((start, size))
            start += size
    return pieces


PIECES = "class int, worker long, number long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], capacity: int, with_ids: bool) -> DataFrame:
    """Pieces with their worker and their number among its pieces of the same class."""
    of = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = encoder(), TaskContext.get().partitionId()
        seen = [0] * capacity.bit_length()
        for batch in batches:
            rows, columns = [], [[] for _ in range(8)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + np.array([END_ID], "<u4").tobytes()
                n = len(ids) // 4
                for start, length in cut_points(n, capacity):
                    kind = (capacity // length).bit_length() - 1
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(i)
                    for column, value in zip(columns, (kind, worker, seen[kind], start, length, zlib.crc32(part), n, part), strict=True):
                        column.append(value)
                    seen[kind] += 1
            kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 8 if with_ids else 7]
            doc = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            names = [field.split(" ")[0] for field in PIECES.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([doc, *arrays], ["doc_id", *names])

    schema = f"doc_id {of}, {PIECES}" + ", ids binary" * with_ids
    return small_batches(docs.select("doc_id", "text")).mapInArrow(pieces, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """With sequence_id and offset, from staged pieces.

    The running sum goes over one small row per worker and class. Of a class with n pieces, the first n - n % k
    fill sequences of k; the r = n % k others form one sequence for each binary digit of r.
    """
    counts = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))
    offsets = counts.select("class", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).join(totals, "class")
    ranked = pieces.join(offsets, ["class", "worker"]).withColumn("rank", F.col("ahead") + F.col("number"))
    k = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("class"))
    full = F.floor(F.col("total") / k)
    i, rest = F.col("rank") - full * k, F.col("total") - full * k
    # The digit of the rest that piece i belongs to: the highest in which the two differ.
    digit = F.length(F.bin(i.bitwiseXOR(rest))) - 1
    size = F.call_function("shiftleft", F.lit(1).cast("long"), digit.cast("int"))
    own = i >= 0
    sequence = F.when(own, full + F.lit(capacity.bit_length()) - digit).otherwise(F.floor(F.col("rank") / k))
    slot = F.when(own, i % size).otherwise(F.col("rank") % k)
    classes = capacity.bit_length()
    return ranked.withColumns({
        "sequence_id": (sequence * classes + F.col("class")).cast("long"), "offset": (slot * F.col("length")).cast("long"),
    }).drop("class", "worker", "number", "ahead", "total", "rank")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    `capacity` is a power of two. Defined results: a null or empty text is the end id alone; each row is a
    document of its own, repeated and null doc_id included; other columns are not read; an empty table gives
    no pieces. Tokens are not shuffled: the pieces are staged where they were cut, and take their places there.
    """

    def encoder() -> Callable[[str], bytes]:
        return worker_state(f"word-encoder {vocabulary}", lambda: WordEncoder(vocabulary)).encode

    return place(stage(cut_documents(docs, encoder, capacity, with_ids), "pieces"), capacity)


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
