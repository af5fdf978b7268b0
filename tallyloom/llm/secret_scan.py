"""Secret scan: strong patterns, and weak parts of a credential that count only where complementary parts meet.

A credential often comes as several parts: who (access identifier), what (secret) and where (endpoint). Each
weak part alone is noise. Parts are found in one pass over the whole texts, then an interval join within
scopes keeps those that have their complement nearby.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches, stage, table

# Base patterns with the least length of the group that decides (fixed values of the contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")

# Weak parts: a named identifier, a long mixed token without a name, a host in a URL or a named host.
IDENTIFIER = re.compile(r"""\b(?:client_?id|access_?key_?id|user(?:name)?|login|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:@-]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.I | re.A)

# Most characters between a part and its complement.
REACH = 200


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(token: str) -> bool:
    """Digits, upper and lower case in one token: words and numbers are not secrets."""
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    found += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if looks_random(m[0])]
    if "://" in text or "=" in text or ":" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found)


def apart(spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of `taken`; both are sorted by start."""
    starts, reach, out = [s for s, _, _ in taken], [], []
    for _, _, end in taken:
        reach.append(max(end, reach[-1] if reach else 0))
    for span in spans:
        before = bisect.bisect_left(starts, span[2])
        if not before or reach[before - 1] <= span[0]:
            out.append(span)
    return out


SPAN = "array<struct<start:bigint,kind:bigint,end:bigint,scope:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and weak spans of each row; scope counts the blank lines before a span."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))
    blank = re.compile(r"\n[\x20\t\r]*\n")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, weak = [], []
            for text in batch.column("text").to_pylist():
                strong = base_spans(text) if text else []
                loose = apart(weak_spans(text), strong) if text else []
                breaks = [m.start() for m in blank.finditer(text)] if strong or loose else []
                base.append(_scoped(strong, breaks))
                weak.append(_scoped(loose, breaks))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(weak, kind)], ["doc_id", "base", "weak"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(spans, f"doc_id {of}, base {SPAN}, weak {SPAN}")


def _scoped(spans: list[tuple[int, int, int]], breaks: list[int]) -> list[tuple[int, int, int, int]]:
    out, scope = [], 0
    for start, kind, end in spans:
        while scope < len(breaks) and breaks[scope] < start:
            scope += 1
        out.append({"start": start, "kind": kind, "end": end, "scope": scope})
    return out


# Complements: an identifier and an opaque token vouch for each other, or are vouched for by a strong secret or
# access key; an endpoint counts where an identifier and a secret of any kind are near.
WHO, WHAT = ("access", "identifier"), ("assign", "hex", "opaque")


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """row, start, kind, end of the weak parts with complements in the same scope and no more than `reach` between the two.

    An interval join over buckets of `reach` characters: a part is listed in every bucket that it touches, and looks
    for its complements in those and the two beside them. Existence is asked for, so a crowded bucket emits no pairs.
    """
    role = F.when(F.col("kind").isin([KINDS.index(k) for k in WHO]), "who").when(F.col("kind").isin([KINDS.index(k) for k in WHAT]), "what")
    first, last = F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)
    near = parts.select("row", "scope", F.explode(F.sequence(first, last)).alias("bucket"), role.alias("role"), "start", "end").where("role is not null")
    # A bucket needs only the first start and the last end of a role: those are the nearest for the buckets beside it.
    bounds = near.groupBy("row", "scope", "bucket").agg(
        *(f(F.when(F.col("role") == r, F.col(at))).alias(f"{r}_{at}") for r in ("who", "what") for at, f in (("start", F.min), ("end", F.max)))
    )
    own = parts.where(F.col("kind") >= KINDS.index("identifier")).select(
        "row", "scope", "start", "kind", "end", role.alias("role"), first.alias("first"), last.alias("last")
    )
    spread = own.select("*", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("bucket"))

    def within(r: str):
        gap = F.when(F.col("bucket") < F.col("first"), F.col("start") - F.col(f"{r}_end"))
        gap = gap.when(F.col("bucket") > F.col("last"), F.col(f"{r}_start") - F.col("end"))
        return F.coalesce(F.max(gap.otherwise(F.when(F.col(f"{r}_start").isNotNull(), 0)) <= reach), F.lit(False))

    seen = spread.join(bounds, ["row", "scope", "bucket"]).groupBy("row", "scope", "start", "kind", "end", "role").agg(
        within("who").alias("who"), within("what").alias("what")
    )
    wanted = F.when(F.col("role") == "who", F.col("what")).when(F.col("role") == "what", F.col("who")).otherwise(F.col("who") & F.col("what"))
    return seen.where(wanted).select("row", "start", "kind", "end")


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, base and linked: spans in code points with their kind, one row per row of `docs`.

    Defined results: a null text is empty; rows that share a doc_id are scanned one by one; a null doc_id is
    scanned like any other; other columns are not read. The texts are read once; the spans are staged in the
    shared folder, and only they move for the join.
    """
    found = stage(scan(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    parts = found.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*")
    linked = link_parts(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.join(linked, "row", "left").select(
        "doc_id", slim.alias("base"), F.coalesce("linked", F.array().cast(slim_type())).alias("linked")
    )


def slim_type() -> str:
    return "array<struct<start:bigint,kind:bigint,end:bigint>>"


def _listed(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"], s["end"])), ","
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )
