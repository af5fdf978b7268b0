"""Token counts: prefix dynamic programming over byte-level BPE stores the exact count at every prefix of a text.

A text is cut into units: a run of white space with the word, number or punctuation run behind it. No merge
and no cut crosses a unit's end, whatever follows, so the count of a text cut anywhere is the count of its
whole units plus that of a prefix of one unit. Inside a unit, byte by byte, exactly one token can end the
encoding of a prefix: the one that fits behind the last token of a shorter prefix. Units repeat, so a task
computes each once, and a text is a chain of looked-up steps.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches, table, worker_state

# Words of the byte-level pre-tokenizer (fixed values of the vocabulary).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
UNIT = regex.compile(r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
BLANK = regex.compile(r"\s*")
# Distinct units that a worker remembers before it starts anew: bounds its memory on any corpus.
REMEMBERED = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of all prefixes under one byte-level BPE vocabulary."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        byte_of = byte_alphabet()
        raw = lambda token: bytes(byte_of[c] for c in token)
        # Numbers in the order of the merges: the 256 bytes, then one for each merge, with the two parts it joins.
        self.number = {bytes([b]): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["model"]["merges"]:
            a, b = (raw(part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            pair = (self.number[a], self.number[b])
            self.joined[pair] = self.number.setdefault(a + b, len(self.parts))
            self.parts.append(pair)
        special = {t["content"] for t in model["added_tokens"]}
        # An automaton of the vocabulary, built as far as texts lead: a state is the longest beginning of a token that ends at a place.
        self.beginnings = {token[:at] for token in self.number for at in range(1, len(token) + 1)}
        self.state_of: dict[bytes, int] = {}
        self.read: list[bytes] = []
        # By state, (length, number) of the tokens that end there, the shortest first.
        self.ending: list[tuple[tuple[int, int], ...]] = []
        self.next: dict[int, int] = {}
        self.state(b"")
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.fits: dict[int, bool] = {}
        self.steps: dict[str, bytes] = {}

    def follows(self, last: int, token: int) -> bool:
        """Whether `last` then `token` is how their bytes are encoded.

        It is not if a merge across their border would have come before the merges that made them: the two
        are taken apart at the border, the later merge first, and each pair that then touches is looked up.
        """
        bound, left, right = len(self.parts), last, token
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                bound, left = left, self.parts[left][1]
            else:
                bound, right = right + 1, self.parts[right][0]

    def state(self, read: bytes) -> int:
        """The number of the state of these bytes."""
        found = self.state_of.get(read)
        if found is None:
            found = self.state_of[read] = len(self.read)
            self.read.append(read)
            tails = (read[at:] for at in range(len(read) - 1, -1, -1))
            self.ending.append(tuple((len(t), self.number[t]) for t in tails if t in self.number))
        return found

    def advance(self, key: int) -> int:
        """The state behind state key >> 8 and byte key & 255."""
        read = self.read[key >> 8] + bytes([key & 255])
        while read not in self.beginnings:
            read = read[1:]
        if len(self.next) > REMEMBERED:
            self.next.clear()
        found = self.next[key] = self.state(read)
        return found

    def chain(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ... word[:n]."""
        counts, last, state, follow, ending, fits = [0], [-1], 0, self.next, self.ending, self.fits
        for end, byte in enumerate(word, 1):
            key = state << 8 | byte
            state = follow.get(key)
            if state is None:
                state = self.advance(key)
            for length, token in ending[state]:
                start = end - length
                if start:
                    pair = last[start] << 32 | token
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) > REMEMBERED:
                            fits.clear()
                        fit = fits[pair] = self.follows(last[start], token)
                    if not fit:
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
        return counts

    def counts_by_char(self, text: str) -> list[int]:
        """Counts of one pre-token's prefixes, by code points."""
        raw = text.encode()
        counts = self.chain(raw)
        if len(raw) == len(text):
            return counts[1:]
        ends, at = [], 0
        for c in text:
            at += len(c.encode())
            ends.append(counts[at])
        return ends

    def unit_steps(self, unit: str) -> bytes:
        """How the count changes with each code point of a unit, as 16-bit numbers.

        Cut inside its white space, the blanks so far are one pre-token; with a word behind them, the last
        blank goes to the word if it is a space and stands alone if not. A contraction that is cut short is
        an apostrophe and a letter.
        """
        gap = BLANK.match(unit).end()
        word = unit[gap:]
        if word and (unit[:gap] == " " or not gap and word not in CONTRACTIONS):
            counts = self.counts_by_char(unit)
            return array("h", [counts[0], *map(sub, counts[1:], counts)]).tobytes()
        counts = self.counts_by_char(unit[:gap]) if gap else []
        if word:
            ahead = counts[gap - 2] if gap > 1 else 0
            if gap and unit[gap - 1] == " ":
                counts += [ahead + n for n in self.counts_by_char(" " + word)[1:]]
            else:
                ahead += self.counts_by_char(unit[gap - 1])[0] if gap else 0
                inside = self.counts_by_char(word)
                if word in CONTRACTIONS:
                    inside = [1, *(1 + n for n in self.counts_by_char(word[1:-1])), inside[-1]]
                counts += [ahead + n for n in inside]
        return np.diff(np.array(counts, dtype=np.int64), prepend=0).astype(np.int16).tobytes()

    def plain_counts(self, text: str) -> np.ndarray:
        """Prefix counts of a text without special strings."""
        steps, out = self.steps, []
        for unit in UNIT.findall(text):
            found = steps.get(unit)
            if found is None:
                if len(steps) > REMEMBERED:
                    steps.clear()
                found = self.unit_steps(unit)
                if len(unit) <= 64:
                    steps[unit] = found
            out.append(found)
        return np.frombuffer(b"".join(out), np.int16).cumsum(dtype=np.int32)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:1], text[:2], ... text[:n], as int32.

        A special string counts as one token where it is complete, and as ordinary text where it is cut.
        """
        out, base, at = [], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            cut = self.plain_counts(text[at : m.end() - 1]) + base
            base = (int(cut[m.start() - at - 1]) if m.start() > at else base) + 1
            out += [cut, np.array([base], np.int32)]
            at = m.end()
        if at < len(text):
            out.append(self.plain_counts(text[at:]) + base)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def with_prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, and prefix_counts: the tokens of the first 1, 2, ... n code points of the text.

    Defined results: a null or empty text has an empty array; each row stands for itself, so repeated and null
    doc_id are no matter; other columns are not read. Rows need no shuffle.
    """
    of = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"prefix-counter {vocabulary}", lambda: PrefixCounter(vocabulary))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [counter.prefix_counts(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *counts]).astype(np.int32)))
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, lists], ["doc_id", "n_bytes", "prefix_counts"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(count, f"doc_id {of}, n_bytes long, prefix_counts array<int>")


def token_total(prefix_counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.get(prefix_counts, F.size(prefix_counts) - 1), F.lit(0)).cast("long")


def longest_prefix(prefix_counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens; a longer prefix can have fewer tokens, so the last one counts."""
    fitting = F.transform(prefix_counts, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fitting), F.lit(0)).cast("long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = with_prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n = token_total(F.col("prefix_counts"))
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 512).alias("over_limit"))
