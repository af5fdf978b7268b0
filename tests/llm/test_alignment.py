"""Tokenizer alignment against plain Python: every pair of tokens compared by byte range."""

import collections
import hashlib
import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tallyloom.llm import alignment
from tallyloom.llm.registry import all_queries

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def brute(rows):
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    shown = alignment.byte_alphabet()
    raw_a = {i: bytes(shown[c] for c in t) for t, i in a_model.get_vocab(with_added_tokens=False).items()}
    raw_b = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for doc, text in rows:
        full = (" " + text).encode() if text else b""
        a = [(i, raw_a[i]) for i in a_model.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, raw_b(i)) for i in b_model.encode(text)] if text else []
        if any(b"".join(r for _, r in side) != full for side in (a, b)):
            a, b = [], []
        a, b = spans(a), spans(b)
        links, first = [], 0
        for s, e, i in a:
            while b[first][1] <= s:
                first += 1
            links += [(i, j) for t, f, j in b[first : first + e - s] if t < e and s < f]
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        group_of = {}
        for number, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
            group_of |= dict.fromkeys(range(low, high), number)
        groups = [([], []) for _ in ends]
        for k, side in enumerate((a, b)):
            for low, _, i in side:
                groups[group_of[low]][k].append(str(i))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in groups]
        docs.append((doc, len(a), len(b), len(ends), links, groups))
    totals = collections.Counter(pair for *_, links, _ in docs for pair in links)
    highest = collections.Counter()
    for (_, j), n in totals.items():
        highest[j] = max(highest[j], n)
    for doc, n_a, n_b, n_groups, links, groups in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        yield doc, n_a, n_b, n_groups, len(links), sum(totals[p] == highest[p[1]] for p in links), sum(totals[p] for p in links), digest


def same(found, rows):
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows), key=str)


def test_alignment_matches_brute_force(spark):
    rng = random.Random(3)
    letters = ["a", "b", " ", "  ", "\n", "é", "ß", "日", "本", "🙂", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "\t", "\0", "\x7f", "'s", "1", "23", ".", "the ", "ing", " ", "ﬁ", "é"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "   "), (None, "one text"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (1004, "word " * 40_000), (1005, "x" * 30_000), (1006, " " * 9_000)]
    frame = spark.createDataFrame([(*r, 1, "p", b"h", 2) for r in rows], "doc_id long, text string, pair long, batch string, holders binary, n long")
    found = alignment.align_documents(frame.repartition(3), A_PATH, B_PATH)
    assert found.columns == COLUMNS
    same(found.collect(), rows)
    assert alignment.align_documents(frame.limit(0), A_PATH, B_PATH).count() == 0


def test_batches_do_not_matter(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gammadelta", "x9"]) for _ in range(30))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
    same(alignment.align_documents(frame, A_PATH, B_PATH).collect(), rows)


def test_both_encoders_of_side_a_agree():
    side = alignment.ByteLevel(A_PATH)
    rng = random.Random(6)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b  {chr(c)}'s" for c in rng.sample(points, 20_000)]
    for text, fast in zip(texts, side.encode(texts), strict=True):
        assert fast == side.slow.encode(text, add_special_tokens=False).ids


def test_query_on_its_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = all_queries()["op13_tokenizer_alignment"](spark, sf_dir)
    assert found.columns == COLUMNS
    same(found.collect(), rows)
