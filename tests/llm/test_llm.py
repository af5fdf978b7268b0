"""Operators of tallyloom.llm against brute force on small fixtures, with nulls, repeats, ties, long and empty texts."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import (
    decontaminate, embedding_dedup, license_scan, line_dedup, ngram_jaccard, packing, secret_scan, token_counts, toxicity, warc,
)
from tallyloom.llm.common import fresh_path, shared_root
from tallyloom.llm.components import connected_components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Names that the operators use themselves, as extra columns of the input.
EXTRA = "row long, id string, tag string, body string, n long, component long, digest string, score string, key string"
DOCS = f"doc_id long, text string, {EXTRA}"


def docs_of(spark, texts):
    """Rows of (doc_id, text) with clashing extra columns."""
    return spark.createDataFrame([(i, t, 7, None, "x", "y", 3, None, "d", "s", "k") for i, t in texts], DOCS)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def prose(rng, n):
    return " ".join(rng.choice(["ba", "da", "fi", "go", "hu", "ka", "lo", "mi", "no", "pe"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(8)]
    for i in range(12):
        w = base[20 + i % 6].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "ONE"), (305, "two words"), (None, base[1]), (None, None)]
    rows += [(0, base[0]), (0, base[0]), (1, base[2]), (306, prose(rng, 30_000)), (307, "=" * 20_000), (308, "É" * 300)]
    return rows


# ---- components -----------------------------------------------------------

def test_components(spark):
    chain = [(i, i + 1) for i in range(10, 40)] + [(90, 80), (80, 70), (5, 5)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(10, 41), 10), 70: 70, 80: 70, 90: 70}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 embeddings ----------------------------------------------------------

def test_embedding_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    for g in range(20):
        x[60 * g : 60 * g + g] = x[60 * g] + rng.normal(size=(g, 24)) * 0.12
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, rows[7][1]), (5001, rows[7][1]), (5002, None), (5003, [0.0] * 24), (5004, [float("nan")] + [1.0] * 23), (5005, [None] + [1.0] * 23)]
    rows += [(5006, [float("inf")] * 24), (5007, [1.0, 2.0]), (5008, [2.0, 4.0]), (5009, []), (None, rows[9][1]), (7, rows[11][1])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id long")
    found = sorted((tuple(r) for r in embedding_dedup.near_duplicates(vectors).collect()), key=str)

    usable = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for k in usable:
        same = [j for j in usable if len(rows[j][1]) == len(rows[k][1])]
        m, q = np.array([rows[j][1] for j in same]), np.array(rows[k][1])
        links[k] = {j for j, c in zip(same, m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q)) if c >= 0.95 and j != k}
    expected = []
    for k, (vec, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            todo = [j for i in todo for j in links[i] if j not in reach]
            reach |= set(todo)
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        expected.append((vec, len(links[k]), least, True if vec is None else vec == least))
    assert found == sorted(expected, key=str)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_embedding_search_splits_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_SIZE", 150)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[:400] = x[0] + rng.normal(size=(400, 16)) * 0.1
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(vectors).cache()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum() - len(x)
    assert 0.9 * true <= found.agg(F.sum("n_links")).first()[0] <= true
    assert embedding_dedup.audit_recall(vectors, found, every=10) >= 0.9


def test_embedding_hot_group_shares_cells(spark):
    """20,000 near copies have several centres of their own; all their links have a common cell."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60_000, 64))
    x[:20_000] = x[0] + rng.normal(size=(20_000, 64)) * 0.2
    x[20_000:20_200] = x[30_000:30_200] + rng.normal(size=(200, 64)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    columns = {"id": pa.array(range(len(x))), "copies": pa.array([1] * len(x)), "unit": pa.array(list(x), pa.list_(pa.float64()))}
    classes = spark.createDataFrame(pa.table(columns)).withColumn("dim", F.size("unit"))
    centres = embedding_dedup.fit_centres(classes, 0.95)
    assert len(centres[64][0]) == 60 and (centres[64][0] @ x[:20_000].mean(axis=0) > 0.9).sum() > 1
    cells = {r.id: set(r.cells) for r in embedding_dedup.assign(classes, centres, 0.95).select("id", "cells").collect()}
    for some in (range(0, 20_000, 200), range(20_000, 20_200)):
        links = [(i, int(j)) for i in some for j in np.flatnonzero(x @ x[i] >= 0.95) if i != j]
        assert len(links) > 100 and sum(bool(cells[i] & cells[j]) for i, j in links) >= 0.99 * len(links)
    assert np.mean([len(c) for c in cells.values()]) < 6


def test_embedding_hot_group_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CLUSTER_SIZE", 60)
    monkeypatch.setattr(embedding_dedup, "SHARD_SIZE", 300)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 32))
    x[:1200] = x[0] + rng.normal(size=(1200, 32)) * 0.2
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert all(found[i] <= n for i, n in enumerate(true)) and sum(found.values()) >= 0.99 * true.sum()


def test_embedding_audit_reads_every_chosen_id(spark):
    """Links lost at high ids only show beyond the first 1,000 chosen ones."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(1000, 16)), 3, axis=0)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = spark.createDataFrame([(i, 2 * (i < 1500)) for i in range(3000)], "vec_id long, n_links long")
    assert embedding_dedup.audit_recall(vectors, found, every=1) == 0.5
    assert embedding_dedup.audit_by_size(vectors, found, every=10) == {2: (300, 600)}


# ---- 2 n-gram Jaccard ------------------------------------------------------

def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def linked(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(i)
    return sets, members


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_matches_brute_force(spark, texts, width, percent):
    sets, members = linked(texts, width, percent)
    least = {i: min((texts[j][0] for j in m if texts[j][0] is not None), default=None) for m in members.values() for i in m}
    expected = sorted(((d, len(sets[i]), least[i]) for i, (d, _) in enumerate(texts)), key=str)
    found = ngram_jaccard.link(docs_of(spark, texts), width, percent).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    kept = ngram_jaccard.keep_one(docs_of(spark, texts), width, percent)
    assert kept.columns == docs_of(spark, []).columns
    stay = sorted((texts[min(m, key=lambda i: (texts[i][0] is None, texts[i][0] or 0))][0] for m in members.values()), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == stay


def test_jaccard_group_of_near_copies(spark):
    """Long lists go through the rounds of chance neighbours; nothing is lost."""
    rng = random.Random(9)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    _, members = linked(rows, 3, 80)
    expected = {rows[i][0]: min(rows[j][0] for j in m) for m in members.values() for i in m}
    found = ngram_jaccard.link(docs_of(spark, rows), 3, 80)
    assert {r.doc_id: r.component_id for r in found.collect()} == expected


def test_jaccard_leaves_no_large_tables(spark):
    """Whole sets, prefixes and lists are removed as soon as nothing reads them; they stayed until the session ended."""
    held = lambda: {f.name for f in Path(re.sub("^file:(//)?", "", shared_root(spark))).glob("llm-*")}
    before, words = held(), [f"w{i}" for i in range(60)]
    found = ngram_jaccard.link(docs_of(spark, [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other words here"), (4, None)]))
    left = {name.split("-")[1] for name in held() - before}
    assert not left & {"sets", "ends", "prefixes", "vertices", "postings", "rows"} and "linked" in left
    assert sorted(found.select("doc_id", "n_shingles", "component_id").collect()) == [(1, 58, 1), (2, 57, 1), (3, 1, 3), (4, 0, 4)]


def test_jaccard_empty(spark):
    assert ngram_jaccard.link(docs_of(spark, [])).count() == 0
    assert ngram_jaccard.link(docs_of(spark, [(1, None), (2, "")])).select("component_id").orderBy("component_id").collect() == [(1,), (2,)]


# ---- 3 licences ------------------------------------------------------------

LICENSED = [
    "Released under the MIT License. Under the MIT license again", "Apache License, Version 2.0", "CC-BY-NC 4.0", "not licensed under the GPL v2",
    "This program is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: BSD-3-Clause", "mit mit MIT Licence",
    "licensed under the terms of the GNU Lesser General Public License v2.1 or under the MIT license", "All rights reserved.", None, "", "under the mit license" * 2,
    "under the mit license " * 3000, "Creative Commons Attribution-NonCommercial-ShareAlike",
]


def licences(text):
    low = " " + " ".join(words_of(text)) + " "
    base, places = [], []
    for number, _, label, priority, pattern, is_base in license_scan.rules():
        for m in re.finditer(pattern, low):
            start = low[: m.start()].count(" ") - 1
            (base if is_base else places).append((start, start + m[0].count(" ") + 1, priority, number, label))

    def inside(p, q):
        longer = (q[1] - q[0], -q[3]) > (p[1] - p[0], -p[3])
        return q[0] <= p[0] and p[1] <= q[1] and (q[2] > p[2] or q[2] == p[2] and longer)

    kept = [p for p in places if p[4] and not any(inside(p, q) for q in places)]
    labels = lambda x: ",".join(sorted({p[4] for p in x}))
    score = max([license_scan.WEIGHTS[p[2]] for p in kept] + [license_scan.BASE_WEIGHT] * bool(base) + [0.0])
    first = (min((p[0] for p in base), default=None), max((p[0] for p in base), default=None))
    return (len(words_of(text)), len(base), *first, labels(base), labels(base + kept), score)


def test_licenses_match_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(LICENSED)] + texts + [(0, LICENSED[0])]
    found = [tuple(r) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(((d, *licences(t)) for d, t in rows), key=str)
    assert license_scan.scan_licenses(docs_of(spark, [])).count() == 0


def test_license_rules():
    rules = license_scan.rules()
    assert len(rules) > 300 and [r[0] for r in rules] == list(range(len(rules)))
    assert licences("not licensed under the GPL v2")[5] == ""
    assert licences("licensed under the GNU General Public License v2 or later")[5] == "gpl-2"


def spelled(pattern, rng):
    """A text that the pattern matches, by chance among its alternatives."""
    def of(parts):
        out = ""
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(value)
            elif name == "IN":
                kind, chosen = rng.choice(value)
                out += "x" if str(kind) == "CATEGORY" else chr(chosen if str(kind) == "LITERAL" else rng.randint(*chosen))
            elif name == "SUBPATTERN":
                out += of(value[-1])
            elif name == "BRANCH":
                out += of(rng.choice(value[1]))
            elif name == "MAX_REPEAT":
                out += "".join(of(value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
            else:
                assert name == "ASSERT"
        return out
    return of(re._parser.parse(pattern))


def test_license_prefilter_passes_every_rule(spark):
    rng, rows = random.Random(12), set()
    for number, family, _, _, pattern, _ in license_scan.rules():
        for _ in range(400 if family in license_scan.BARE else 40):
            rows.add((number, spelled(pattern, rng)))
    texts = sorted({t for _, t in rows})
    at = {t: i for i, t in enumerate(texts)}
    words = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, tag long, words string")
    found = {tuple(r) for r in license_scan.find_rules(words).select("rule", "id").distinct().collect()}
    assert {n for n, _ in rows} == set(range(len(license_scan.rules())))
    assert [(n, t) for n, t in sorted(rows) if (n, at[t]) not in found] == []


def test_license_names_without_common_keywords(spark):
    texts = [
        "Public Domain Dedication and License", "SPDX-License-Identifier: CPL-1.0", "licensed under CPL 1.0", "licensed under PSF 2.0", "licensed under ISC",
        "released under the ISC", "subject to MIT", "under the terms of MIT", "Offered MIT.", "permitted by mitigation, the iscariot",
    ]
    found = [tuple(r) for r in license_scan.scan_licenses(docs_of(spark, list(enumerate(texts)))).collect()]
    assert sorted(found) == sorted((i, *licences(t)) for i, t in enumerate(texts))
    assert [r[6] != "" for r in sorted(found)] == [True] * 9 + [False]


def test_license_work_is_done_once_and_on_few_texts(spark):
    inside = ["summit license", "kapache", "rubyx scubacc by", "unproprietary", "permitted by mitigation"]
    assert [t for t in inside if re.search(license_scan.gate(), f" {t} ")] == ["rubyx scubacc by"]
    families = {f for f, _ in license_scan.keywords()}
    assert families == {f for f, _ in license_scan.names()} == {r[1] for r in license_scan.rules()}
    named = {f for f, name in license_scan.names() if re.search(name, " apache php ruby python bsd eclipse under the mit license ")}
    assert named == {"base mit", "mit"}
    plan = license_scan.scan_licenses(docs_of(spark, [(1, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1


# ---- 4 toxicity ------------------------------------------------------------

def test_toxicity_learns_sentences_from_documents(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        sentences = [prose(rng, 8) for _ in range(rng.randrange(2, 7))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] = f"you {rng.choice(['grumbus', 'snarkle', 'blorfing'])} {prose(rng, 3)}"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    docs, marked = docs_of(spark, rows), spark.createDataFrame([*labels, (0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marked)
    scored = toxicity.score(docs, model).select("row.doc_id", "score", "offences").collect()
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored if r.doc_id in set(held)]
    assert sum(right) / len(right) > 0.97
    text = dict(rows)
    places = [text[r.doc_id][o.start : o.end] for r in scored if r.doc_id % 4 == 0 for o in r.offences]
    assert sum("you " in p for p in places) / len(places) > 0.9
    kept = toxicity.drop_toxic(docs, marked)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0").count() < 8 and kept.where("doc_id % 4 <> 0").count() > 440


def test_toxicity_without_labels_or_text(spark, texts):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(spark, texts)
    scored = toxicity.score(docs, toxicity.train(docs, none))
    assert scored.where("score < 0.5").count() == len(texts) and scored.where("row.text is null and score = 0").count() == 2
    assert toxicity.drop_toxic(docs_of(spark, []), none).count() == 0


def test_toxicity_fit_in_bounded_memory():
    """Features of distinct words took some 500 bytes a word, and a worker kept them."""
    texts = [" ".join(f"word{d}x{i}" for i in range(500)) + (". fool idiot" if d % 3 else "") for d in range(300)]
    tracemalloc.start()
    model = toxicity.fit(texts, [int(d % 3 > 0) for d in range(300)], rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights and peak < 40e6


# ---- 5 packing -------------------------------------------------------------

def test_word_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, rng = packing.WordEncoder(path), random.Random(1)
    pieces = [*"abethIS'srvmld  \n\t.!?=-123é漢😀ΣÉİ  <|", "'re", "'LL", "<|endoftext|>", "the ", "\n\n", "é"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert encoder.encode(text) == encoder.whole(text), text


def test_packing_round_trip(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r.asDict() for r in packing.pack(docs_of(spark, texts), path, with_ids=True).collect()]
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    expected = sorted((d, ids(t).tobytes()) for d, t in texts if d is not None and d > 1)
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        if r["doc_id"] is not None and r["doc_id"] > 1:
            assert len(by_doc.setdefault(r["doc_id"], b"")) == 4 * r["start"]
            by_doc[r["doc_id"]] += r["ids"]
    assert sorted(by_doc.items()) == expected
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) for _, t in texts)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.setdefault(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] += r["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_word_encoder_equals_the_library_on_every_code_point():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    same = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b" for c in points]
    assert [encoder.encode(t) for t in texts] == same(texts)
    rng = random.Random(7)
    letters = [*map(chr, range(1, 256)), "\u2028", "\u1680", "Σ", "ς", "İ", "ﬁ", "\u0301", "'s", "'RE", "🙂", "\U0001E030"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    assert [encoder.encode(t) for t in texts] == same(texts)


# ---- 6 secrets -------------------------------------------------------------

KIND = {k: i for i, k in enumerate(secret_scan.KINDS)}


def test_secret_spans(spark):
    key, long_hex, mixed = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2, "aB3" * 8
    rows = [
        (1, f"password = hunter2hunter2 and {key}\n{long_hex}"), (2, "token=short; secret: 'longenough1'"), (3, None), (4, ""),
        (5, f"client_id = abcdef\nblob {mixed}\nhttps://api.example.com/x"), (6, f"just a blob {mixed}"), (7, "user: somebody\n\npassword=abcdefgh12"),
        (8, f"host=db.example.com {key} password=abcdefgh12"), (9, "é😀 password=abcdefgh12"), (10, "AKIA123 " + "f" * 31), (None, f"{key}"), (1, f"{key}"),
        (11, f"client_id = abcdef {' x' * 150} {mixed}"), (12, f"{mixed} " * 2000 + "login: somebody"),
    ]
    found = {(r.doc_id, tuple(map(tuple, r.base)), tuple(sorted(map(tuple, r.linked)))) for r in secret_scan.find_secrets(docs_of(spark, rows)).collect()}
    by_id = {}
    for doc, base, linked_parts in found:
        by_id.setdefault(doc, []).append(([(secret_scan.KINDS[k], s, e) for s, k, e in base], [(secret_scan.KINDS[k], s) for s, k, _ in linked_parts]))
    assert len(found) == len(rows)
    assert by_id[9][0] == ([("assign", 3, 22)], []) and by_id[10][0] == ([], []) and by_id[3][0] == by_id[4][0] == ([], [])
    assert [k for k, _, _ in by_id[1][0][0] + by_id[1][1][0]].count("access") == 2
    assert by_id[2][0][0] == [("assign", 13, 33)]
    assert [k for k, _ in by_id[5][0][1]] == ["identifier", "opaque", "endpoint"] and by_id[6][0][1] == [] and by_id[7][0][1] == [] and by_id[11][0][1] == []
    assert [k for k, _ in by_id[8][0][1]] == ["endpoint"]
    close = [s for k, s in by_id[12][0][1] if k == "opaque"]
    at = len(f"{mixed} " * 2000)
    assert close == [s for s in range(0, at, len(mixed) + 1) if at - s <= secret_scan.REACH]
    assert secret_scan.find_secrets(docs_of(spark, [])).count() == 0


def test_secret_parts_of_any_length(spark):
    tokens = [("aB3" * 2000)[:n] for n in (128, 129, 5000)]
    names = ["a1-" * 20 + ".apps.googleusercontent.com", "u" * 5000]
    rows = [(i, f"client_id=abcdef {t}") for i, t in enumerate(tokens)] + [(10 + i, f"client_id={n}\n{tokens[0]}") for i, n in enumerate(names)]
    found = {r.doc_id: sorted(map(tuple, r.linked)) for r in secret_scan.find_secrets(docs_of(spark, rows)).collect()}
    for i, t in enumerate(tokens):
        assert (17, KIND["opaque"], 17 + len(t)) in found[i] and (0, KIND["identifier"], 16) in found[i]
    assert (0, KIND["identifier"], 10 + len(names[0])) in found[10]
    assert (0, 3, 10 + len(names[1])) in [(m.start(), 3, m.end()) for m in secret_scan.IDENTIFIER.finditer(rows[-1][1])]


def test_secret_parts_beside_long_ones(spark):
    """Any intervals against all pairs, then texts: what counts is the gap, whatever the lengths."""
    rng, parts = random.Random(11), []
    for row in range(60):
        for _ in range(rng.randrange(2, 9)):
            start = rng.randrange(3000)
            parts.append((row, rng.randrange(2), start, rng.randrange(6), start + rng.choice([5, 60, 199, 200, 201, 700])))
    who, what = ({KIND[k] for k in kinds} for kinds in (secret_scan.WHO, secret_scan.WHAT))
    expected = set()
    for row, scope, start, kind, end in parts:
        near = {k for r, c, s, k, e in parts if (r, c) == (row, scope) and max(s - end, start - e) <= secret_scan.REACH}
        if kind >= KIND["identifier"] and all(near & role for role in ([what] if kind in who else [who] if kind in what else [who, what])):
            expected.add((row, start, kind, end))
    table = spark.createDataFrame(parts, "row long, scope long, start long, kind long, end long")
    assert {tuple(r) for r in secret_scan.link_parts(table).collect()} == expected and len(expected) > 20

    rows = [(1, "password=" + "x1" * 150 + " user=alice"), (2, "0123456789abcdef" * 20 + f"{' ' * 200}user=alice"), (3, "0123456789abcdef" * 20 + f"{' ' * 201}user=alice")]
    found = {r.doc_id: [k for _, k, _ in r.linked] for r in secret_scan.find_secrets(docs_of(spark, rows)).collect()}
    assert found == {1: [KIND["identifier"]], 2: [KIND["identifier"]], 3: []}


# ---- 7 token counts --------------------------------------------------------

def test_prefix_counts_equal_encoding_each_prefix(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, tokenizer, rng = token_counts.PrefixCounter(path), Tokenizer.from_file(path), random.Random(1)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    pieces = [*"abethis'srvmld  \n\t.!?=-123é漢😀    <|", "'re", "'ll", "<|endoftext|>", "the ", "  ", "\n\n", "'"]
    for _ in range(700):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert counter.prefix_counts(text).tolist() == [count(text[:i]) for i in range(1, len(text) + 1)], text
    found = token_counts.with_prefix_counts(docs_of(spark, texts), path)
    total = found.select("doc_id", "n_bytes", token_counts.token_total(F.col("prefix_counts"))).collect()
    assert sorted(map(tuple, total), key=str) == sorted(((d, len((t or "").encode()), count(t or "")) for d, t in texts), key=str)
    cut = found.where("doc_id = 306").select(token_counts.longest_prefix(F.col("prefix_counts"), 100)).first()[0]
    text = dict(texts)[306]
    assert count(text[:cut]) <= 100 and all(count(text[:i]) > 100 for i in range(cut + 1, cut + 40))
    assert token_counts.with_prefix_counts(docs_of(spark, []), path).count() == 0


def test_token_counts_look_up_no_substrings():
    """Each byte is read once; the walk back over all ends of up to 128 bytes took most of the time."""

    class Read(bytes):
        slices = 0

        def __getitem__(self, place):
            Read.slices += isinstance(place, slice)
            return super().__getitem__(place)

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = token_counts.PrefixCounter(path)
    tokenizer = Tokenizer.from_file(path)
    for word in ("internationalization", "a" * 300, "-" * 200, "zqxjkv" * 20):
        counts = counter.chain(Read(word.encode()))
        assert counts == [len(tokenizer.encode(word[:n], add_special_tokens=False).ids) for n in range(len(word) + 1)]
    assert not Read.slices


# ---- 8 line dedup ----------------------------------------------------------

@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup_matches_brute_force(spark, least):
    rng = random.Random(6)
    pool = ["a common line of text", "  A Common LINE of text\t", "short", "É upper stays", "é upper stays", "x" * 9, "y" * 10, " " + "Y" * 10 + "\r", ""]
    rows = [(i, "\n".join(rng.choice(pool + [f"own line number {i} {rng.randrange(3)}"]) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "a common line of text"), (3, rows[3][1]), (3, "a common line of text"), (60, "\n".join(["y" * 10] * 5000))]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and d is not None:
                holders.setdefault(key(line), set()).add(d)
    expected = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < least or d == min(holders[key(x)])]
        expected.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.drop_repeated_lines(docs_of(spark, rows), least).select("row.doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(expected, key=str)
    assert line_dedup.drop_repeated_lines(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("share", [1, 10, 10**9])
def test_hot_lines_leave_where_they_are(spark, monkeypatch, share):
    """A line of a third of all rows gives the same result on the broadcast way, the shuffled way and both."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rows = [(i, "\n".join(["The hot line of all", f"own line of {i} here", f"shared by two {i // 2}", "short"])) for i in range(60)]
    found = line_dedup.drop_repeated_lines(docs_of(spark, rows)).select("row.doc_id", "kept_text").collect()
    expected = [
        (i, "\n".join(["The hot line of all"] * (i == 0) + [f"own line of {i} here"] + [f"shared by two {i // 2}"] * (i % 2 == 0) + ["short"]))
        for i in range(60)
    ]
    assert sorted(map(tuple, found)) == expected


# ---- 9 decontamination -----------------------------------------------------

def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 12, 5, 1, 30, 14])] + [(7, None), (8, " .. "), (None, prose(rng, 20)), (5, prose(rng, 15))]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(1, 200)).split(" ")
        for _, t in rng.sample(items, 2):
            if t and rng.random() < 0.6:
                part = t.upper().split(" ")[rng.randrange(3) :]
                at = rng.randrange(len(w))
                w[at:at] = part
        rows.append((i, ", ".join(w)))
    rows += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (102, "plain"), (None, items[1][1]), (103, (items[5][1] + " ") * 300)]
    windows = {}
    for item, t in items:
        w = words_of(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(item)
    expected = []
    for d, t in rows:
        w, hit, names = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names |= {str(i) for i in windows[tuple(w[s : s + n])] if i is not None}
        expected.append((d, len(w), len(hit), len(names), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n string")
    measured = decontaminate.measure(docs_of(spark, rows), benchmark).drop("tag")
    assert sorted((tuple(r) for r in measured.collect()), key=str) == sorted(expected, key=str)
    kept = decontaminate.remove_contaminated(docs_of(spark, rows), benchmark)
    assert kept.columns == docs_of(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((e[0] for e in expected if not e[5]), key=str)
    cleaned = decontaminate.remove_spans(docs_of(spark, [(1, items[0][1] + " keep This"), (2, None), (3, "as it is.")]), benchmark)
    assert {r.doc_id: r.clean_text for r in cleaned.collect()}[1].endswith("keep This") and cleaned.where("clean_text = 'as it is.'").count() == 1
    assert decontaminate.measure(docs_of(spark, rows), benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.measure(docs_of(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("bytes_", [0, 2**20])
def test_decontamination_on_both_sides_of_the_broadcast_bound(spark, monkeypatch, bytes_):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bytes_)
    benchmark = spark.createDataFrame([(1, "alpha beta gamma"), (2, "word " * 12 + "end"), (3, "ΣΑΣ σας K")], "item_id long, text string")
    long = "word " * 60_000 + "End."
    rows = [(1, "x Alpha-beta, gamma y"), (2, long), (2, long), (3, "σας k ΣΑΣ. σας K"), (4, "alpha beta"), (None, "ALPHA beta gamma")]
    found = decontaminate.measure(docs_of(spark, rows), benchmark).select("doc_id", "n_hit", "n_words", "items").collect()
    expected = [(1, 3, 5, ["1"]), (2, 13, 60_001, ["2"]), (2, 13, 60_001, ["2"]), (3, 3, 5, ["3"]), (4, 0, 2, []), (None, 3, 3, ["1"])]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_common_words_of_windows_add_no_work(spark):
    """Windows that share every word but one are probed by the whole n-gram: rows out of the probe are the hits."""
    benchmark = spark.createDataFrame([(i, "commonest " * 12 + f"w{i}") for i in range(200)], "item_id long, text string")
    windows = decontaminate.stage(decontaminate.test_windows(benchmark), "windows")
    hits = decontaminate.find_windows(docs_of(spark, [(i, "commonest " * 500 + f"w{i}") for i in range(50)]), windows)
    assert hits.count() == 50 and hits.select("window").distinct().count() == 50


# ---- 10 archives -----------------------------------------------------------

def test_archives_round_trip(spark):
    pages = [(3, "http://a/ b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (4, "http://c", ""), (5, "http://d", "x\r\n\r\nWARC/1.1\r\n\r\ny\n"), (5, "http://d", "x\r\n\r\nWARC/1.1\r\n\r\ny\n")]
    pages += [(None, "http://e", "<p>é</p>"), (6, "http://f", "z" * 300_000)]
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    warc.write_arc(table.repartition(3), arc)
    warc.convert(spark, arc, out)
    rows = warc.read_warc(spark, out).collect()
    name = {r.id: r.page_id for r in rows}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert len(rows) == len(name) == len(pages) and all(r.intact for r in rows)
    assert sorted(((r.page_id, r.n_bytes, r.digest) for r in rows), key=str) == sorted(((p, len((t or "").encode()), digest(t)) for p, _, t in pages), key=str)
    kinds = sorted(((r.page_id, r.kind, name.get(r.refers_id)) for r in rows), key=str)
    assert kinds == sorted([(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "revisit", 2), (5, "response", None), (5, "revisit", 5), (6, "response", None)], key=str)


def test_legacy_headers():
    v1 = b"filedesc://x 0.0.0.0 19970101000000 text/plain 77\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
    v1 = warc.arc_file_header("x", 1, "19970101000000") + b"\nhttp://a/has blank 1.2.3.4 19970102030405 text/html 5\nhello\nhttp://b 1.2.3.4 19970102 text/html 9\nshort"
    parsed = list(warc.parse_arc(v1))
    assert [(f["URL"], b, p) for _, f, b, p in parsed[1:]] == [("http://a/has blank", b"hello", None), ("http://b", b"short", "block shorter than declared")]
    v2 = warc.arc_file_header("x", 2, "19970101000000") + b"\n" + warc.arc_record(9, "http://c", "hi", 2, "19991231235959") + b"\nbroken line\n"
    parsed = list(warc.parse_arc(v2))
    assert parsed[1][1]["Result-code"] == "200" and warc.split_http(parsed[1][2])[1] == b"hi" and parsed[2][3] == "header line without a length"
    assert warc.iso_date("19991231235959") == "1999-12-31T23:59:59Z" and warc.iso_date("?") == "1970-01-01T00:00:00Z"
    assert list(warc.parse_arc(b"")) == []


def test_empty_pages(spark):
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), arc)
    warc.convert(spark, arc, out)
    assert warc.read_warc(spark, out).count() == 0
