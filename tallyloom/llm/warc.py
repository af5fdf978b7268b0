"""Legacy archive converter: ARC files of version 1 or 2 become WARC files with revisits, and are read back.

Archives are written and read by Spark's own readers and writers, so they may lie in any store Spark knows.
One task writes one archive; archives are gzip files. Records are cut by declared lengths only, so payloads
may hold any bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh_path, small_batches, stage, table

# Field names of an ARC version block, by version (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_HEADER = "X-Page-Id"
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def legacy_url(url: str | None) -> str:
    """A URL that fits a field of an ARC header line: blanks, controls and non-ASCII are percent-encoded."""
    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._") or "about:blank"


def arc_record(page_id: int | None, url: str | None, html: str | None, version: int, date: str) -> bytes:
    """Header line and HTTP response of one page."""
    body = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
    if page_id is not None:
        head += f"{PAGE_HEADER}: {page_id}\r\n"
    block = head.encode() + CRLF + body
    ahead = f"{legacy_url(url)} 0.0.0.0 {date} text/html"
    if version == 2:
        ahead += " 200 - - 0 -"
    return f"{ahead} {len(block)}\n".encode() + block


def arc_file_header(name: str, version: int, date: str) -> bytes:
    """The version block that opens an ARC file."""
    text = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    ahead = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        ahead += " 200 - - 0 -"
    return f"{ahead} {len(text)}\n".encode() + text


def write_arc(pages: DataFrame, path: str, date: str = "20200101000000") -> None:
    """One ARC file for each task; tasks take versions 1 and 2 in turn."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        yield _lines([arc_file_header(f"part-{part:06d}.arc", version, date)])
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield _lines([arc_record(*row, version, date) for row in rows])

    _write(small_batches(pages.select("page_id", "url", "html")).mapInArrow(records, "record binary"), path, "\n")


def _lines(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])


def _write(records: DataFrame, path: str, end: str) -> None:
    """Bytes as they are, each record followed by `end`."""
    out = records.select(F.col("record").cast("string")).write.option("lineSep", end).option("compression", "gzip")
    out.option("zlib.compress.level", "THREE").text(path)


def _open(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 20)


def parse_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(number, fields, block, problem) for each record, the version block first.

    Fields are named by the file's own version block. A header line is cut from the right, so a blank in an
    old URL stays in it. A record whose length is not a number ends the file with a problem, as there is no
    way to find the next one; a block shorter than declared is given with a problem.
    """
    file, names, number = _open(content), ARC_FIELDS[1].split(" "), 0
    while line := file.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        # The first line comes before its own field list: an old URL record has 5 fields, a version 2 one 10.
        if number == 0 and len(text.split(" ")) >= 10:
            names = ARC_FIELDS[2].split(" ")
        fields = dict(zip(names, text.rsplit(" ", len(names) - 1), strict=False))
        length = fields.get(names[-1], "")
        if not length.isdigit():
            yield number, fields, b"", "header line without a length"
            return
        block = file.read(int(length))
        yield number, fields, block, None if len(block) == int(length) else "block shorter than declared"
        if number == 0 and fields["URL"].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            if len(lines) > 1 and lines[1].strip():
                names = lines[1].strip().split(" ")
        number += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload."""
    head, gap, payload = block.partition(CRLF + CRLF)
    return (head + gap, payload) if block.startswith(b"HTTP/") and gap else (b"", block)


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(CRLF)[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1")
    return None


def iso_date(date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date; one that is no date becomes the epoch."""
    d = (date + "0" * 14)[:14] if date.isdigit() and len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    """The same identifier whenever the same record of the same archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


RECORDS = "file string, number long, id string, page_id long, uri string, ip string, date string, mime string, problem string, head binary, payload binary, digest string, n_bytes long"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below `path`, with synthesised WARC identifiers, dates and digests."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name, rows, held = file.rsplit("/", 1)[-1], [], 0
                for number, fields, block, problem in parse_arc(content.as_py()):
                    if fields.get("URL", "").startswith("filedesc:"):
                        continue
                    head, payload = split_http(block)
                    page, date = header_value(head, PAGE_HEADER), iso_date(fields.get("Archive-date", ""))
                    digest = payload_digest(payload)
                    rows.append({
                        "file": name, "number": number, "id": record_id(name, number, fields.get("URL"), date, digest),
                        "page_id": int(page) if page and page.lstrip("-").isdigit() else None, "uri": fields.get("URL"),
                        "ip": fields.get("IP-address"), "date": date, "mime": fields.get("Content-type"), "problem": problem,
                        "head": head, "payload": payload, "digest": digest, "n_bytes": len(payload),
                    })
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = _arrow(RECORDS)
    return _files(spark, path).mapInArrow(records, RECORDS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return small_batches(spark.read.format("binaryFile").load(path).select("path", "content"))


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """With first_id, first_uri and first_date where an equal payload of at least `min_bytes` is already a response.

    Of equal payloads the record with the smallest page_id is the response; without page_id a record comes
    last; ties go by identifier. The search shuffles a digest per record and keeps one row per digest.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("id").alias("first_id"), F.col("uri").alias("first_uri"), F.col("date").alias("first_date"))
    firsts = (
        records.where((F.col("n_bytes") >= min_bytes) & F.col("problem").isNull())
        .groupBy("digest", "n_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "n_bytes", "first.first_id", "first.first_uri", "first.first_date")
    )
    joined = records.join(firsts, ["digest", "n_bytes"], "left")
    again = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("id")) & F.col("problem").isNull()
    return joined.withColumns({c: F.when(again, F.col(c)) for c in ("first_id", "first_uri", "first_date")})


def warc_record(row: dict) -> bytes:
    """A response, or a revisit whose block is the HTTP head alone. Damaged records go in as they are, truncated."""
    again = row["first_id"] is not None
    block = row["head"] if again else row["head"] + row["payload"]
    fields = [
        ("WARC-Type", "revisit" if again else "response" if row["head"] else "resource"),
        ("WARC-Record-ID", row["id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("WARC-Refers-To", row["first_id"]), ("WARC-Refers-To-Target-URI", row["first_uri"]), ("WARC-Refers-To-Date", row["first_date"]),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None),
        ("WARC-Truncated", "length" if row["problem"] else None),
        ("Content-Type", "application/http; msgtype=response" if row["head"] else row["mime"]), ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + CRLF + block


def warc_info(name: str) -> bytes:
    block = b"software: legacy archive converter\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC file for each task, opened by a warcinfo record."""
    columns = ["id", "page_id", "uri", "ip", "date", "mime", "problem", "head", "payload", "digest", "first_id", "first_uri", "first_date"]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _lines([warc_info(f"part-{TaskContext.get().partitionId():06d}.warc")])
        for batch in batches:
            yield _lines([warc_record(row) for row in batch.to_pylist()])

    _write(small_batches(records.select(*columns)).mapInArrow(out, "record binary"), path, "\r\n\r\n")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """ARC files below one path to WARC files below another."""
    write_warc(mark_revisits(read_arc(spark, arc_path), min_bytes), warc_path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields in lower case, and block, of each record."""
    file = _open(content)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := file.readline()).strip():
            key, _, value = line.decode().partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, file.read(int(fields.get("content-length", 0)))


READ_BACK = "id string, page_id long, kind string, n_bytes long, digest string, refers_id string, intact long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per response, resource or revisit, digests taken from the payload itself where the record has it."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    page = header_value(head, PAGE_HEADER)
                    declared = fields["warc-payload-digest"].removeprefix("sha1:")
                    again = fields["warc-type"] == "revisit"
                    digest = declared if again else payload_digest(payload)
                    rows.append({
                        "id": fields["warc-record-id"], "page_id": int(page) if page and page.lstrip("-").isdigit() else None, "kind": fields["warc-type"],
                        "n_bytes": int(header_value(head, "Content-Length") or 0) if again else len(payload), "digest": digest,
                        "refers_id": fields.get("warc-refers-to"), "intact": int(digest == declared and fields["warc-block-digest"] == f"sha1:{payload_digest(block)}"),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = _arrow(READ_BACK)
    return _files(spark, path).mapInArrow(records, READ_BACK)


def op10_archive_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and what the WARC files hold.

    Defined results: null html is an empty payload, equal to every other empty one; a null url is about:blank;
    a page without page_id is archived, comes last among equals and reads back as null; repeated rows are
    records of their own, of which one is the response; an empty table gives archives without pages.
    """
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    back = stage(read_warc(spark, warc), "read-back")
    named = back.where("kind <> 'revisit'").select(F.col("id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return back.join(named, "refers_id", "left").select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.when(F.col("kind") == "revisit", "revisit").otherwise("response").alias("record_type"), "refers_to",
    )


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), bits AS (
  SELECT *, list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
         (((strpos('0123456789abcdef', substring(hex, 1 + (5 * i + j) // 4, 1)) - 1) // (2 ** (3 - (5 * i + j) % 4))::BIGINT) % 2)
         * (2 ** (4 - j))::BIGINT))::BIGINT, 1)) AS b
  FROM p
)
SELECT page_id, payload_bytes, array_to_string(b, '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""
