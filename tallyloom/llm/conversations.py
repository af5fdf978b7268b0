"""Conversation structure repair: the cheapest edits to an optional system turn and user/assistant pairs.

Each row of a conversation is reduced to one letter: what is wrong with it and the initial of its role. The edits are
a path through a DAG of (row, last role kept), and its weight is one big integer: the high digits are the cost,
the low ones, of fixed width, the letters of the edits in order, left-aligned with zeros behind the end. The smallest
integer is the cheapest path, and among those the ASCII-least audit; nothing else decides.

The letters need no texts, so these are shuffled once, later, to be hashed in order; a task streams both passes
and holds a few bytes per row of a conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_staged, small_batches, stage, table, worker_state

# Costs of the edits, the extra cost of a truncated row that stays, and the digits of the audit letters in ASCII order (fixed values of the contract).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
# What counts as text, and what ends a sentence (fixed values of the contract).
VISIBLE, ENDING = r"[^\x20\x09-\x0D]", r"[.!?]"
TRUNCATED_TEXT = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$"
# Last role kept: none yet, system, user, assistant; and where a row of each role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL_NEIGHBOURS = {"su", "ua", "au"}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
REMEMBERED = 100_000


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage; nulls of role and text are one space.

    `copy` is 0 for a row, 1 for its repeat, and -1 for a dropped one, which stays to tell of its conversation.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), ENDING, "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    copies = F.when(kind == 0, F.array(F.lit(-1))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def with_digest(rows: DataFrame) -> DataFrame:
    """`digest` tells whether role and text were seen before; it also settles the order of rows of one turn and role."""
    return rows.withColumn("digest", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text"))))


def flaw(text: Column) -> Column:
    """b: nothing visible; t: the last visible character ends no sentence; else o."""
    return F.when(~text.rlike(VISIBLE), "b").when(text.rlike(TRUNCATED_TEXT), "t").otherwise("o")


class Weights:
    """Big-integer weights of one conversation: the cost above `width` bits of audit."""

    def __init__(self, n_rows: int):
        # At most one row is inserted before each row and two at the end.
        self.width = BITS * (2 * n_rows + 2)
        self.mask = (1 << self.width) - 1
        self.digit = {letter: d << (self.width - BITS) for letter, d in LETTERS.items()}

    def step(self, letter: str, cost: int, rest: int) -> int:
        """The weight of an edit and of all that follow: their letters move one digit down."""
        return (((rest >> self.width) + cost) << self.width) | self.digit[letter] | ((rest & self.mask) >> BITS)


def repair(codes: list[str]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; a code is b (blank), d (duplicate), t (truncated) or o, and the role's initial."""
    w = Weights(len(codes))
    never = 1 << (w.width + BITS * len(codes) + 64)

    def with_inserts(best: list[int]) -> list[int]:
        user = min(best[USER], w.step("I", INSERT, best[ASSISTANT]))
        assistant = min(best[ASSISTANT], w.step("I", INSERT, best[USER]))
        first = w.step("I", INSERT, user)
        return [min(best[START], first), min(best[SYSTEM], first), user, assistant]

    best = with_inserts([0, never, never, 0])
    for code in reversed(codes):
        gone = [w.step("D", DELETE, b) for b in best]
        if code[0] not in "bd":
            extra = TRUNCATED if code[0] == "t" else 0
            for state in range(4):
                kept = NEXT.get((state, code[1:]))
                if kept is not None:
                    gone[state] = min(gone[state], w.step("K", extra, best[kept]))
                gone[state] = min(gone[state], w.step("R", REROLE + extra, best[ASSISTANT if state == USER else USER]))
        best = with_inserts(gone)
    audit, digits = [], best[START] & w.mask
    letter_of = {d: letter for letter, d in LETTERS.items()}
    # The digits as octal text, most significant first; the zeros behind the end are no letters.
    for d in f"{digits:o}".zfill(w.width // BITS):
        if d == "0":
            break
        audit.append(letter_of[int(d)])
    return best[START] >> w.width, "".join(audit)


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PLANNED = [c.split(" ")[0] for c in PLAN.split(", ")]


class Conversation:
    """Letters of one conversation while its rows pass by."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.seen: set[bytes] = set()
        self.illegal, self.last = 0, None
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turn: int | None, initial: str, digest: bytes, fault: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns, self.last_turn = self.turns + 1, turn
        if fault != "b" and digest in self.seen:
            fault = "d"
        self.seen.add(digest)
        if self.last is not None and self.last + initial not in LEGAL_NEIGHBOURS:
            self.illegal += 1
        self.last = initial
        # Only the initials of the grammar matter to the repair, so that conversations alike share a plan.
        self.codes.append(fault + (initial if initial in ("s", "u", "a") else "?"))

    def plan(self) -> tuple:
        known = worker_state("conversation-plans", dict)
        key = "".join(self.codes)
        found = known.get(key)
        if found is None:
            found = repair(self.codes)
            if len(known) >= REMEMBERED:
                known.clear()
            if len(key) <= 64:
                known[key] = found
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        faults = [code[0] for code in self.codes]
        return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), self.illegal, *found)


def in_order(rows: DataFrame, *first: Column) -> DataFrame:
    """All rows of a conversation in one task, in order: by turn, nulls first, ties by role and text, repeats adjacent."""
    order = [F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def plan_repairs(rows: DataFrame) -> DataFrame:
    """conv_id and PLAN per conversation, from damaged rows."""
    of = rows.schema["conv_id"].dataType.simpleString()
    small = with_digest(rows).select("conv_id", "turn", "role", "digest", "copy", F.substring("role", 1, 1).alias("initial"), flaw(F.col("text")).alias("fault"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_id, kind = None, None, None
        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "copy", "turn", "initial", "digest", "fault"))
            for conv_id, copy, *row in zip(*columns, strict=True):
                if held is None or held_id != conv_id:
                    done += [(held_id, *held.plan())] if held else []
                    held, held_id = Conversation(), conv_id
                if copy >= 0:
                    held.add(*row)
            yield planned(done, kind)
        if held:
            yield planned([(held_id, *held.plan())], kind)

    def planned(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * (len(PLANNED) - 1), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", *PLANNED])

    ordered = in_order(small).select("conv_id", "copy", "turn", "initial", "digest", "fault")
    return ordered.mapInArrow(plan, f"conv_id {of}, {PLAN}")


class Repaired:
    """The repaired text of one conversation, hashed while its rows pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.written = audit, 0, START, False
        self.hash = hashlib.sha256()

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written = True

    def next_role(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return ROLE_OF[self.state]

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.write(self.next_role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state, role[:1]]
            self.write(role, text)
        elif edit == "R":
            self.write(self.next_role(), text)

    def digest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


def hash_repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with repaired_sha256: each conversation's plan comes before its rows, which follow its audit."""
    fields = ("turn", "role", "digest", "copy", "text")
    own = with_digest(rows.where("copy >= 0"))
    kinds = dict(own.dtypes)
    heads = plans.select("conv_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in fields], F.struct(*PLANNED).alias("plan"))
    both = heads.unionByName(own.select("conv_id", *fields), allowMissingColumns=True)
    of = rows.schema["conv_id"].dataType.simpleString()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, kind = None, None, None
        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "plan", "role", "text"))
            for conv_id, plan, role, text in zip(*columns, strict=True):
                if plan is None:
                    held.row(role, text)
                    continue
                done += [(*head, held.digest())] if held else []
                held, head = Repaired(plan["audit"]), (conv_id, *plan.values())
            yield hashed(done, kind)
        if held:
            yield hashed([(*head, held.digest())], kind)

    def hashed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * (len(PLANNED) - 1), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", *PLANNED, "repaired_sha256"])

    ordered = in_order(both, F.col("plan").isNull()).select("conv_id", "plan", "role", "text")
    return small_batches(ordered).mapInArrow(follow, f"conv_id {of}, {PLAN}, repaired_sha256 string")


def repair_conversations(damaged: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, the counts of its faults, the cost and letters of its repair, and the repaired text's hash.

    Takes rows as `damage` leaves them (conv_id, turn, role, text, copy); other columns are not read. Defined
    results: a null conv_id is a conversation like any other; rows of a null turn come first; rows of one turn are
    ordered by role and text; a conversation without rows has zeros, an empty audit and the empty text's hash; an
    empty table gives no rows. A hash needs its conversation's texts in order, so a conversation is one task's
    work in both passes; the task streams it and keeps 20 bytes a row or so.
    """
    plans = stage(plan_repairs(damaged), "repair-plans")
    out = stage(hash_repaired(damaged, plans), "repaired")
    drop_staged(plans)
    return out


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))
