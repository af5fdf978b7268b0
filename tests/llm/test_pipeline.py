"""All rows of the pipeline against plain Python, the scores of the first stage as given."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm.toxicity import score, train

ASCII = {i: i + 32 for i in range(65, 91)}
RUDE = ["vile scum", "you filthy scum", "hateful vermin talk"]


def prose(rng, n):
    return " ".join(rng.choice(["ba", "da", "fi", "go", "hu", "ka", "lo", "mi", "no", "pe"]) + str(rng.randrange(400)) for _ in range(n))


def corpus(rng):
    """Texts with toxic ones, exact and near copies, passages of many documents, benchmark items, and empty ones."""
    items = [prose(rng, n) for n in (60, 30, 13, 7)]
    texts = ["\n".join(prose(rng, rng.randrange(10, 60)) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    toxic = [0] * 120
    for i in range(0, 120, 3):
        texts[i], toxic[i] = f"{texts[i]}. {rng.choice(RUDE)} {rng.choice(RUDE)}. {prose(rng, 4)}", 1
    long = [prose(rng, 200) for _ in range(4)]
    passage = prose(rng, 70)
    texts += [texts[1], texts[2].upper(), " \n" + texts[4], *long, *long]
    texts += [f"{t} tail{i}" for i, t in enumerate(long)] + [" ".join(t.split(" ")[:150]) for t in long]
    texts += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}" for _ in range(10)] + [passage, f"{passage}\n{passage}\nshort"]
    texts += [f"{prose(rng, 30)} {items[0]}", f"{prose(rng, 900)} {items[2]}", items[1].upper(), f"{prose(rng, 9)}, {items[3]}"]
    texts += [None, "", " \t\n", "one", "word " * 9000, prose(rng, 5000)]
    return items, texts, toxic


def expected_documents(texts, scores, items):
    """doc_id and text of what the first four stages keep."""
    docs = [(d, t) for d, t in texts if scores[d] < 0.5]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    first = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            first.setdefault(key(line), set()).add(d)
    lines = []
    for d, t in docs:
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 10 or d == min(first[key(x)])]
        changed = len(kept) < len((t or "").split("\n"))
        if not changed or key("\n".join(kept)):
            lines.append((d, "\n".join(kept) if changed else t))
    sets = {}
    for d, t in lines:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    single = [(d, t) for d, t in lines if top[d] == d]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = {tuple(w[s : s + 13]) for w in map(words, items) if w for s in range(max(1, len(w) - 12))}
    kept = []
    for d, t in single:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            hit |= {p for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append((d, t))
    return docs, lines, single, kept


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    items, texts, toxic = corpus(random.Random(11))
    folder = str(tmp_path_factory.mktemp("planted"))
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = given.columns
    rows = [tuple({"doc_id": i, "text": t, "n_chars": len(t or "")}.get(c) for c in names) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in given.dtypes)).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet")), ("doc_id",)).collect()
    stages = expected_documents(list(enumerate(texts)), {r.row.doc_id: r.score for r in scored}, items)
    return folder, docs, texts, toxic, stages


def test_every_stage_keeps_what_plain_python_keeps(spark, planted):
    folder, docs, texts, toxic, stages = planted
    assert [len(s) for s in stages] == sorted({len(s) for s in stages}, reverse=True), "each stage has something to do"
    for (name, function), expected in zip(corpus_pipeline.STAGES, stages, strict=False):
        docs = corpus_pipeline.stage(function(spark, docs, folder), name)
        found = docs.select("doc_id", "text", "n_chars").collect()
        assert sorted((r.doc_id, r.text) for r in found) == expected, name
        assert all(r.n_chars == len(r.text or "") for r in found), name


def test_run_packs_each_id_once(spark, planted):
    folder, _, _, _, stages = planted
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in stages[-1]}
    pieces = corpus_pipeline.run(spark, folder).collect()
    covered, filled = {d: [] for d in ids}, {}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        covered[p.doc_id] += range(p.start, p.start + p.length)
        filled.setdefault(p.sequence_id, []).extend(range(p.offset, p.offset + p.length))
    assert all(sorted(c) == list(range(len(ids[d]))) for d, c in covered.items())
    assert all(sorted(f) == list(range(len(f))) and len(f) <= 4096 and len(f) & (len(f) - 1) == 0 for f in filled.values())
