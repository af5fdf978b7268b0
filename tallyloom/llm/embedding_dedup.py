"""Embedding near-dedup over a flat, robust-pruned graph.

Vectors go to their nearest clusters, as many as an angle margin asks for, and large clusters are split at random,
so every shard has a bounded size. Centres within the link angle of each other are one cluster, so a hot group of near
copies is not cut. Each shard builds a pruned neighbour graph; the lists of a vector from all its shards are
united. Every vector then searches the shards of its clusters: greedily from the shard's medoids, and on from
everything in range. Pairs that were found are closed within their shard and verified in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches, stage, table
from tallyloom.llm.components import connected_components

# The clusters are fitted on at most this many numbers, of the vectors of the smallest hash; all vectors are indexed.
SAMPLE_NUMBERS = 1 << 20
MOST_CLUSTERS = 1024
# Vectors a cluster should have, and most that a shard has.
CLUSTER_SIZE = 1000
SHARD_SIZE = 2048
# Clusters of a vector: so many at least, and all that a linked vector can have as its nearest when the difference of the
# two, seen from both, is at most so many standard deviations along the line between the centres.
OVERLAP = 2
DEVIATIONS = 3
# Graph: candidates looked at, neighbours kept, slack of the pruning, random edges; search: entries and beam.
CANDIDATES = 48
DEGREE = 20
ALPHA = 1.2
RANDOM_EDGES = 4
ENTRIES = 8
BEAM = 40


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, digest and unit (double): both null for a vector that is null, zero, or holds a null or non-finite component."""
    of = vectors.schema["vec_id"].dataType.simpleString()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows = [], []
            for values in batch.column("embedding").to_pylist():
                x = np.array([np.nan if v is None else v for v in values or ()], np.float64)
                scale = np.abs(x).max() if len(x) else 0.0
                if not np.isfinite(scale) or scale == 0:
                    digests.append(None)
                    rows.append(None)
                    continue
                x = x / scale + 0.0
                rows.append(x / np.sqrt(x @ x))
                digests.append(hashlib.blake2b(rows[-1].tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "digest", "unit"]
            )

    return small_batches(vectors.select("vec_id", "embedding")).mapInArrow(units, f"vec_id {of}, digest binary, unit array<double>")


def cluster_centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    return centres


def merged(centres: np.ndarray, threshold: float) -> np.ndarray:
    """The cluster of each centre, numbered from 0: centres within the link angle of each other are one, and so on."""
    a, b = np.nonzero(centres @ centres.T >= threshold)
    return np.unique(groups_of(len(centres), a, b), return_inverse=True)[1]


def fit_centres(classes: DataFrame, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centres and their clusters for each dimension among the vectors, from the bounded sample."""
    centres = {}
    for dim, n in [(r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()]:
        size = max(1, SAMPLE_NUMBERS // dim)
        rows = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(size).select("unit").collect()
        sample = np.array([r.unit for r in rows])
        fitted = cluster_centres(sample, int(np.clip(-(-n // CLUSTER_SIZE), 1, min(MOST_CLUSTERS, len(sample)))))
        centres[dim] = fitted, merged(fitted, threshold)
    return centres


def assign(classes: DataFrame, centres: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float, overlap: int = OVERLAP) -> DataFrame:
    """id, copies, unit, cells: the nearest clusters of every vector, numbered over all dimensions.

    For linked a and b with the nearest centres p and q, (b - a)(q - p) is b's loss at p and a's loss at q together, so one of
    them loses at most half of it. A vector goes to all centres at which it loses no more than that: half of |b - a||q - p|
    always suffices, and of a difference in any direction DEVIATIONS / sqrt(dim) is what must be expected along q - p.
    """
    first, at = {}, 0
    for dim in sorted(centres):
        first[dim], at = at, at + int(centres[dim][1].max()) + 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = {}
        for dim, (c, _) in centres.items():
            apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
            margin[dim] = apart * np.sqrt(max(2 - 2 * threshold, 0)) * min(1, DEVIATIONS / np.sqrt(dim)) / 2 + 1e-9
        for batch in batches:
            cells = []
            for unit in batch.column("unit").to_pylist():
                c, cluster = centres[len(unit)]
                sims = c @ np.array(unit)
                order = np.argsort(-sims, kind="stable")
                close = sims[order[0]] - sims[order] <= margin[len(unit)][order[0], order]
                own = dict.fromkeys(cluster[order[close]].tolist())
                for cell in cluster[order].tolist() if len(own) < overlap else ():
                    own.setdefault(cell)
                    if len(own) == overlap:
                        break
                cells.append([cell + first[len(unit)] for cell in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), batch.column("unit"), pa.array(cells, pa.list_(pa.int64()))], ["id", "copies", "unit", "cells"]
            )

    rows = small_batches(classes.select("id", "copies", "unit"))
    return rows.mapInArrow(nearest, "id long, copies long, unit array<double>, cells array<long>")


def robust_prune(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Neighbour numbers of each vector of a shard.

    The nearest candidate stays and removes those that are nearer to it than to the vector by the slack, and so
    on; edges back, of which the nearest stay, and a few random ones keep the graph navigable.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    width = min(CANDIDATES, n - 1)
    cand = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    own = np.take_along_axis(sims, cand, 1)
    order = np.argsort(-own, axis=1)
    cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
    np.fill_diagonal(sims, 1)
    alive, rows = np.ones_like(cand, bool), np.arange(n)
    source, target = [], []
    for _ in range(DEGREE):
        pick = np.argmax(alive, axis=1)
        left = alive[rows, pick]
        if not left.any():
            break
        best = cand[rows, pick]
        source.append(rows[left])
        target.append(best[left])
        alive[rows, pick] = False
        alive &= ALPHA**2 * (1 - sims[best[:, None], cand]) > 1 - own
    source.append(np.repeat(rows, min(RANDOM_EDGES, n)))
    target.append(rng.integers(0, n, len(source[-1])))
    a, b = np.concatenate(source), np.concatenate(target)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    pairs = pairs[np.lexsort((-sims[pairs[:, 0], pairs[:, 1]], pairs[:, 0]))]
    cuts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    # Far edges are the last of a list; half of the kept ones come from that end.
    kept = []
    for i in range(n):
        own_list = pairs[cuts[i] : cuts[i + 1], 1]
        half = DEGREE
        kept.append(own_list if len(own_list) <= 2 * half else np.concatenate([own_list[: 3 * half // 2], own_list[-(half // 2) :]]))
    return kept


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean, then those farthest from the ones chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    closest = x @ x[chosen[0]]
    while len(chosen) < min(ENTRIES, len(x)):
        chosen.append(int(np.argmin(closest)))
        closest = np.maximum(closest, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(x: np.ndarray, lists: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vertex) pairs in range: greedy search from the medoids with a beam, then on from all that is in range.

    `lists` holds neighbour numbers, padded with -1. Vectors are 32-bit here; the caller verifies.
    """
    n, m = len(x), len(q)
    start = medoids(x)
    beam = min(BEAM, n)
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    ids = np.full((m, beam), -1)
    sims = np.full((m, beam), -2.0, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, : len(start[:beam])] = start[:beam]
    sims[:, : len(start[:beam])] = q @ x[start[:beam]].T
    done[:, : len(start[:beam])] = False
    found_q, found_v = [], []

    def near(which: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unseen neighbours of nodes[i] for query which[i], marked as seen, and their similarities (-2 where there is none)."""
        nb = lists[nodes]
        fresh = (nb >= 0) & ~seen[which[:, None], np.maximum(nb, 0)]
        seen[np.repeat(which, fresh.sum(1)), nb[fresh]] = True
        s = np.full(nb.shape, -2.0, np.float32)
        rows, cols = np.nonzero(fresh)
        s[rows, cols] = np.einsum("ij,ij->i", x[nb[rows, cols]], q[which[rows]])
        return nb, s

    slack = threshold - 1e-4
    hit = q @ x[start].T >= slack
    found_q.append(np.nonzero(hit)[0])
    found_v.append(start[np.nonzero(hit)[1]])
    active = np.arange(m)
    while len(active):
        open_sims = np.where(done[active], -3.0, sims[active])
        pick = np.argmax(open_sims, axis=1)
        go = open_sims[np.arange(len(active)), pick] > -2.5
        active, pick = active[go], pick[go]
        if not len(active):
            break
        done[active, pick] = True
        nb, s = near(active, ids[active, pick])
        rows, cols = np.nonzero(s >= slack)
        found_q.append(active[rows])
        found_v.append(nb[rows, cols])
        all_ids, all_sims = np.hstack([ids[active], nb]), np.hstack([sims[active], s])
        all_done = np.hstack([done[active], s <= -2])
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
    fq, fv = np.concatenate(found_q), np.concatenate(found_v)
    # Range expansion: neighbours of what is in range. Two steps are enough here, since found groups are closed afterwards.
    step_q, step_v = fq, fv
    for _ in range(2):
        more_q, more_v = [], []
        for at in range(0, len(step_q), 20_000):
            which, nodes = step_q[at : at + 20_000], step_v[at : at + 20_000]
            nb, s = near(which, nodes)
            rows, cols = np.nonzero(s >= slack)
            more_q.append(which[rows])
            more_v.append(nb[rows, cols])
        if not more_q or not sum(map(len, more_q)):
            break
        step = np.unique(np.stack([np.concatenate(more_q), np.concatenate(more_v)], 1), axis=0)
        step_q, step_v = step[:, 0], step[:, 1]
        fq, fv = np.concatenate([fq, step_q]), np.concatenate([fv, step_v])
    return fq, fv


def groups_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex number reachable, for n vertices and the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _padded(column: pd.Series, blank: int) -> np.ndarray:
    out = np.full((len(column), max(map(len, column))), blank)
    for i, own in enumerate(column):
        out[i, : len(own)] = own
    return out


def search_block(data: pd.DataFrame, queries: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """id, links, root of one shard and one block of queries: verified links counted in their first common cell."""
    out = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    if not len(data) or not len(queries):
        return out
    x, q = _matrix(data.unit), _matrix(queries.unit)
    ids, qids = data.id.to_numpy(), queries.id.to_numpy()
    number = {v: i for i, v in enumerate(ids.tolist())}
    rows = [[number[v] for v in own if v in number] for own in data.neighbours]
    lists = np.full((len(rows), max(1, max(map(len, rows)))), -1)
    for i, own in enumerate(rows):
        lists[i, : len(own)] = own
    fq, fv = range_search(x.astype(np.float32), lists, q.astype(np.float32), threshold)
    # Queries and data vertices of one id are one vertex of the groups.
    same = np.array([number.get(v, -1) for v in qids.tolist()])
    node = np.where(same >= 0, same, len(x) + np.arange(len(q)))
    groups = groups_of(len(x) + len(q), node[fq], fv)
    links, root = np.zeros(len(q), np.int64), {}
    cells, qcells, copies = _padded(data.cells, -1), _padded(queries.cells, -2), data.copies.to_numpy()
    cell, linked = data.cell.iloc[0], groups[fv[node[fq] != fv]]
    for g in np.unique(linked):
        mine, theirs = np.flatnonzero(groups[node] == g), np.flatnonzero(groups[: len(x)] == g)
        for at in range(0, len(mine), 256):
            part = mine[at : at + 256]
            hit = (q[part] @ x[theirs].T >= threshold) & (qids[part][:, None] != ids[theirs][None, :])
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            shared = (qcells[part[a]][:, :, None] == cells[theirs[b]][:, None, :]).any(axis=2)
            counted = np.where(shared, qcells[part[a]], np.iinfo(np.int64).max).min(axis=1) == cell
            np.add.at(links, part[a[counted]], copies[theirs[b[counted]]])
            sub = groups_of(len(part) + len(theirs), a, len(part) + b)
            names = np.concatenate([qids[part], ids[theirs]])
            least = pd.Series(names).groupby(sub).min()
            for v, s in zip(names.tolist(), sub.tolist(), strict=True):
                root.setdefault(v, set()).add(int(least[s]))
    edges = [(v, 0, r) for v, found in root.items() for r in found if r != v]
    counts = [(int(v), int(n), int(v)) for v, n in zip(qids, links, strict=True) if n]
    return pd.DataFrame(edges + counts, columns=["id", "links", "root"]) if edges or counts else out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding).

    Defined results: a vector that cannot be compared links with nothing; only vectors of equal dimension are
    compared; equal vectors are one vertex and link with each other, repeated rows included; a null vec_id
    takes part without a number of its own and is kept; other columns are not read; an empty table gives no rows.
    Blocks emit one row per vector and group, never their pairs.
    """
    rows = stage(unit_vectors(vectors), "units")
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit")
    )
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = classes.withColumn("dim", F.size("unit"))
    placed = stage(assign(classes, fit_centres(classes, threshold), threshold), "placed")

    member = placed.withColumn("cell", F.explode("cells"))
    parts = member.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_SIZE).cast("long").alias("parts"))
    member = member.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id", "cell"), F.col("parts")))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame.id.to_numpy()
        order = np.argsort(ids)
        kept = robust_prune(_matrix(frame.unit)[order].astype(np.float32), np.random.default_rng(len(ids)))
        return pd.DataFrame({"id": ids[order], "near": [ids[order][k].tolist() for k in kept]})

    graph = member.groupBy("cell", "part").applyInPandas(build, "id long, near array<long>")
    union = stage(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("neighbours")), "graph")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    key = F.struct("cell", "part", "block").alias("key")
    data = member.join(union, "id").select("cell", "part", blocks.alias("block"), "id", "unit", "copies", "cells", "neighbours")
    data = data.select(key, *(F.col(c).alias(c) for c in ("cell", "id", "unit", "copies", "cells", "neighbours")))
    queries = member.select("cell", F.col("part").alias("block"), blocks.alias("part"), "id", "unit", "cells")
    queries = queries.select(key, *(F.col(c).alias(c) for c in ("id", "unit", "cells")))

    def search(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return search_block(data, queries, threshold)

    found = data.groupBy("key").cogroup(queries.groupBy("key")).applyInPandas(search, "id long, links long, root long")
    found = stage(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    part = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    of = classes.select("digest", "id", "copies", "least").join(links, "id", "left").join(part, "id", "left")
    of = of.withColumn("component", F.coalesce("component", "id"))
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(named, "component").select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "digest").join(of, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def audit_by_size(vectors: DataFrame, found: DataFrame, threshold: float = 0.95, every: int = 100, block: int = 1000) -> dict[int, tuple[int, int]]:
    """Links that `found` counts and true links of the vectors whose id `every` divides, by the power of two that their true links reach.

    All of those are compared with all vectors, about `block` at a time; a count above the truth does not make up for one below.
    """
    rows = stage(unit_vectors(vectors).where("digest is not null"), "audit")
    chosen = rows.where(F.col("vec_id") % every == 0)
    blocks, sizes = -(-chosen.count() // block), {}
    for k in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).collect()
        for size, got, n in _audited(rows, part, found, threshold):
            before = sizes.get(size, (0, 0))
            sizes[size] = before[0] + got, before[1] + n
    return sizes


def _audited(rows: DataFrame, chosen: list, found: DataFrame, threshold: float) -> list[tuple[int, int, int]]:
    by_dim = {d: ([r.vec_id for r in chosen if len(r.unit) == d], np.array([r.unit for r in chosen if len(r.unit) == d])) for d in {len(r.unit) for r in chosen}}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            units = batch.column("unit").to_pylist()
            for dim, (ids, q) in by_dim.items():
                x = np.array([u for u in units if len(u) == dim])
                for v, n in zip(ids, (q @ x.T >= threshold).sum(axis=1) if len(x) else [0] * len(ids), strict=True):
                    total[v] = total.get(v, 0) + int(n)
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    true = rows.select("unit").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    both = true.where("n > 0").join(found.select("vec_id", "n_links"), "vec_id").withColumn("size", F.floor(F.log2("n")))
    return [(1 << r.size, r.got, r.all) for r in both.groupBy("size").agg(F.sum(F.least("n", "n_links")).alias("got"), F.sum("n").alias("all")).collect()]


def audit_recall(vectors: DataFrame, found: DataFrame, threshold: float = 0.95, every: int = 100, block: int = 1000) -> float:
    """Share of the true links that `found` counts, over all vectors whose id `every` divides."""
    sizes = audit_by_size(vectors, found, threshold, every, block).values()
    return sum(got for got, _ in sizes) / sum(n for _, n in sizes) if sizes else 1.0


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE unit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) JOIN least USING (vec_id)
"""
