"""Conversation repair against plain Python: faults row by row, repairs by trying every edit in order of cost and letters."""

import hashlib
import heapq
import itertools
import random
import zlib

from tallyloom.llm import conversations
from tallyloom.llm.registry import all_queries

BLANK = " \t\n\v\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if v is None else str(v) for v in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """Dijkstra over (row, last role) in order of (cost, audit): the first finished path is the answer."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        turn = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[turn]
        if len(audit) <= 2 * len(rows) + 2:
            heapq.heappush(heap, (cost + 3, audit + "I", i, turn, (*out, f"{name}:")))
        if i == len(rows):
            continue
        fault, role, text = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 if fault == "truncated" else 0
        if (state, role[:1]) in NEXT:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[state, role[:1]], (*out, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, turn, (*out, f"{name}:{text}")))


def brute(rows, search=cheapest):
    """Rows of the query for conversations given as (conv_id, turn, role, text)."""
    held = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        held[conv].append((turn, role, text))
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            shown = text.strip(BLANK)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        known = {t for t, *_ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, out = search([(f, r, t) for f, (_, r, t) in zip(faults, turns, strict=True)])
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_is_the_least_of_all_edits():
    rng = random.Random(4)
    for _ in range(400):
        codes = [rng.choice(["o", "o", "o", "t", "b", "d"]) + rng.choice(["s", "u", "a", "u", "a", "?"]) for _ in range(rng.randrange(0, 8))]
        fault = {"o": "", "t": "truncated", "b": "blank", "d": "duplicate"}
        cost, audit, _ = cheapest([(fault[c[0]], c[1], "x.") for c in codes])
        assert conversations.repair(codes) == (cost, audit), codes


def test_conversations_match_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(300), None]:
        turns = rng.sample(range(-3, 12), rng.randrange(1, 8))
        for k, turn in enumerate(turns):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("system" if k == 0 and rng.random() < 0.3 else ["user", "assistant"][k % 2])
            rows.append((conv, turn if rng.random() > 0.05 else None, role, rng.choice(["One. Two!", "no end", "why?  \n", "", " \t\v", "ü.", "same."])))
    rows += [(900, 1, None, None), (900, 2, "user", None), (901, 5, "", "x."), (901, 5, "", "x."), (902, 10**12, "Unknown", "y" * 200_000 + ".")]
    rows += [(902, 10**12, "user", "z."), (902, 10**12, "user", "z.")]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, copy string, plan int")
    found = conversations.repair_conversations(conversations.damage(frame))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)
    assert conversations.repair_conversations(conversations.damage(frame.limit(0))).count() == 0


def test_a_long_conversation_and_one_without_rows(spark):
    rng = random.Random(2)
    gone = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(1, t, ["user", "assistant"][t % 2], f"text {rng.randrange(400)}.") for t in range(3000)] + [(gone, 0, "user", "x.")]
    found = {r.conv_id: r for r in conversations.repair_conversations(conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert tuple(found[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # The audit is played by hand: it uses every row once, gives the grammar, and costs what it says.
    long = found[1]
    kept = list(damaged(rows[:-1]))
    assert sum(c != "I" for c in long.audit) == len(kept)
    expected = dict(zip(COLUMNS, next(brute(rows[:-1], lambda r: (0, "", ()))), strict=True))
    assert [long[c] for c in COLUMNS[1:6]] == [expected[c] for c in COLUMNS[1:6]]
    edits, at, initials = iter(long.audit), 0, ""
    for edit in edits:
        role = "" if edit == "I" else kept[at][2]
        at += edit != "I"
        if edit != "D":
            initials += role[0] if edit == "K" else "a" if initials.endswith("u") else "u"
    assert initials == "ua" * (len(initials) // 2)


def test_query_on_its_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = all_queries()["op12_conversation_repair"](spark, sf_dir)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)
