"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learn from document labels.

A document is a bag of sentences and only the bag is labelled. A sentence is toxic with probability
sigmoid(bias + the weights of the words in it and in the sentences beside it), a document with 1 - prod(1 - p).
Training passes the label of the document back to the sentences that explain it, so the same scores locate the
offending ones. What a document's probability is worth is read from rows that the fit has not seen.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import release_memory, small_batches, table

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
# Word beginnings that are features beside the word: inflected and compounded forms share them.
BEGINNINGS = (4, 5)
# The classifier is fitted on at most this many labelled rows, those of the smallest hash, of any length, until they hold so many characters.
TRAIN_ROWS = 8_000
TRAIN_CHARS = 20_000_000
FEATURES = 4096
LEAST_DOCS = 3
REMEMBERED = 200_000
# Words whose features a fit remembers.
FIT_REMEMBERED = 50_000


@dataclass
class Model:
    """Weights by feature number, the bias of a sentence, and how the log odds of a document are read."""

    weights: dict[int, float]
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def features(word: str) -> list[int]:
    """Numbers of the word and of its beginnings."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:n]}-".encode()) for n in BEGINNINGS if len(word) >= n)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def with_neighbours(z: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Each sentence's sum and those of the sentences beside it; `joined` tells whether sentence i + 1 belongs to the document of i."""
    out = z.copy()
    out[1:] += z[:-1] * joined
    out[:-1] += z[1:] * joined
    return out


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through log odds and labels, held near 1 and 0 where rows are few."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = p * (1 - p)
        pull = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + 0.1 * b])
        a, b = np.array([a, b]) - np.linalg.solve([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]], pull)
    return float(max(a, 0.1)), float(b)


def learn(texts: list[str], labels: list[int]) -> Model:
    """A model of all rows, its log odds read as two models of half the rows each predict the other half."""
    model, y = fit(texts, labels), np.array(labels, float)
    halves = [np.arange(k, len(texts), 2) for k in range(2)]
    if any(len(set(y[h])) < 2 for h in halves):
        return model
    z = np.zeros(len(texts))
    for own, other in (halves, halves[::-1]):
        half = fit([texts[i] for i in own], [labels[i] for i in own])
        known: dict[str, float] = {}
        z[other] = log_odds(np.array([bag(half, texts[i], known)[0] for i in other]))
    model.slope, model.offset = calibrate(z, y)
    return model


def bag(model: Model, text: str, known: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Noisy-or of a text, the probabilities of its sentences, whether their own words are a quarter of the reason at least, and their places; `known` keeps weights of words."""
    z, ends = [], []
    for m in SENTENCE.finditer(text):
        total = 0.0
        for word in WORD.findall(m[0].lower()):
            weight = known.get(word)
            if weight is None:
                if len(known) > REMEMBERED:
                    known.clear()
                weight = known[word] = model.word_weight(word)
            total += weight
        z.append(total)
        ends.append(m.span())
    own = np.array(z, float)
    reason = with_neighbours(own, np.ones(max(len(z) - 1, 0)))
    p = sigmoid(model.bias + reason)
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), p, 4 * own >= reason, ends


def in_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in the order in which they first occur, and the place there of each id."""
    found, first, place = np.unique(ids, return_index=True, return_inverse=True)
    order = np.argsort(first)
    new = np.empty(len(found), np.int32)
    new[order] = np.arange(len(found), dtype=np.int32)
    return found[order], new[place]


def fit(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """Noisy-or likelihood by Adam over the features that tell the classes apart most.

    With one class only, or no rows, nothing is learnt and every sentence has the probability of the bias.
    """
    if len(set(labels)) < 2:
        return Model({}, -12.0)
    y = np.array(labels, bool)
    # Features lie packed, and few words are remembered, so that a worker is left small when the fit is done.
    of_word: dict[str, bytes] = {}
    docs, sizes, ids = array("i"), array("i"), array("I")
    for d, text in enumerate(texts):
        for sentence in SENTENCE.findall(text.lower()):
            before = len(ids)
            for word in WORD.findall(sentence):
                found = of_word.get(word)
                if found is None:
                    if len(of_word) >= FIT_REMEMBERED:
                        of_word.clear()
                    found = of_word[word] = array("I", features(word)).tobytes()
                ids.frombytes(found)
            docs.append(d)
            sizes.append(len(ids) - before)
    del of_word
    doc, at = np.array(docs, np.int64), len(docs)
    row = np.repeat(np.arange(at, dtype=np.int32), np.array(sizes, np.int64))
    names, feature = in_order(np.frombuffer(ids, np.uint32))
    del ids
    count = len(names)
    seen = np.unique(doc[row] * count + feature)
    hit, of = y[seen // max(count, 1)], seen % max(count, 1)
    pos, all_ = np.bincount(of[hit], minlength=count), np.bincount(of, minlength=count)
    want = all_ * y.mean()
    chi = np.where(all_ >= LEAST_DOCS, (pos - want) ** 2 / np.maximum(want, 1e-9), 0)
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    chosen = chosen[chi[chosen] > 4]
    new = np.full(count, -1, np.int64)
    new[chosen] = np.arange(len(chosen))
    use = new[feature] >= 0
    row, feature = row[use], new[feature[use]]
    n = len(chosen)
    joined = (doc[1:] == doc[:-1]).astype(float)
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = np.log(max(y.mean(), 1e-3)) - np.log(max(at / len(y), 1)) - 1
    for step in range(1, rounds + 1):
        p = sigmoid(theta[n] + with_neighbours(np.bincount(row, theta[feature], at), joined))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        toxic = -np.expm1(clean)
        pull = np.where(y, -np.exp(clean) / np.maximum(toxic, 1e-9), 1.0)
        g = pull[doc] * p / len(y)
        grad = np.append(np.bincount(feature, with_neighbours(g, joined)[row], n), g.sum()) + decay * np.append(theta[:n], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({int(names[c]): float(theta[i]) for i, c in enumerate(chosen)}, float(theta[n]))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; one without id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, place of at most TRAIN_ROWS labelled rows of TRAIN_CHARS characters in all, none held out; a doc_id with several labels is toxic if one says so."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # The labels are at most TRAIN_ROWS rows of two numbers; a doc_id that many rows share could exceed the bound of the rows.
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(known), "doc_id").withColumn("place", F.xxhash64("doc_id", "text"))
    sized = rows.select("place", F.length("text").alias("chars")).orderBy("place").limit(TRAIN_ROWS)
    so_far = sized.withColumn("total", F.sum("chars").over(Window.orderBy("place")))
    kept = so_far.where(F.col("total") <= TRAIN_CHARS).select("place").distinct()
    return rows.join(F.broadcast(kept), "place", "left_semi").select("text", "toxic", "place")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit in one task on the bounded rows; the driver receives the weights only."""

    def from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        model = learn(texts, [int(t > 0) for t in toxic])
        del texts, toxic
        release_memory()
        own = [model.offset, model.slope, model.bias]
        yield pa.RecordBatch.from_pydict({"feature": [-3, -2, -1, *model.weights], "weight": [*own, *model.weights.values()]})

    ordered = training_rows(docs, labels).repartition(1).sortWithinPartitions("place", "toxic")
    found = {r.feature: r.weight for r in small_batches(ordered).mapInArrow(from_rows, "feature long, weight double").collect()}
    return Model({f: w for f, w in found.items() if f >= 0}, found.get(-1, -12.0), found.get(-2, 1.0), found.get(-3, 0.0))


OFFENCES = "array<struct<start:bigint,end:bigint,p:double>>"


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """The columns `keep` of every row as struct `row`, with score and the offending sentences (p >= 0.5, mostly by their own words; places in code points).

    Defined results: a null or empty text has no sentences and scores 0; each row stands for itself, repeated
    and null doc_id included; other columns are carried in `row`, whatever their names. Rows need no shuffle.
    """
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores, places = [], []
            for text in batch.column("text").to_pylist():
                chance, p, own, ends = bag(model, text or "", known)
                scores.append(float(sigmoid(model.slope * log_odds(chance) + model.offset)) if ends else 0.0)
                places.append([{"start": ends[i][0], "end": ends[i][1], "p": float(p[i])} for i in np.flatnonzero((p >= 0.5) & own)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), pa.array(places, place)], ["row", "score", "offences"])
        known.clear()
        release_memory()

    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("offences", T.DataType.fromDDL(OFFENCES))])
    return small_batches(rows).mapInArrow(rate, out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `threshold` or more."""
    return score(docs, train(docs, labels)).where(F.col("score") < threshold).select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ("doc_id",))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offences").cast("long").alias("n_offences"),
    )
