"""WARC archives: written by Spark's text sink, read back by a reader that survives damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Stages

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# A gzip member takes records up to so many bytes: damage costs no more than one member's records.
MEMBER_BYTES = 64 << 10
# Members of a packed archive file, some 16 MB unpacked, as one task reads a file whole; and pages
# of a plain one.
FILE_MEMBERS = 256
FILE_RECORDS = 4_000
RECORD_ID = "urn:page:"
WARC_DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def base32(hexadecimal: Column) -> Column:
    """Base 32 of 40 hexadecimal digits (a SHA-1)."""
    characters = []
    for k in range(8):
        value = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(31)
            characters.append(F.substring(F.lit(ALPHABET), at + 1, F.lit(1)))
    return F.concat(*characters)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record for each row of ``pages`` (page_id, url, html), as text.

    Of the rows whose payloads are equal and have at least ``least_bytes``, that with the largest
    page_id is a response and the others revisit it. A null html is an empty payload; a null
    url leaves the target out; line breaks in it become spaces. Rows that repeat the largest id
    are all responses, and so are rows of a group without ids.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1(F.encode("payload", "UTF-8")), "bytes": F.octet_length("payload")})
    kept = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first_id"))
    rows = rows.join(kept, ["sha1", "bytes"], "left").withColumn(
        "revisit", (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    rows = rows.withColumn("block", F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload")))

    def line(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), *value)

    identity = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), c.cast("string"), F.lit(">"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", identity(F.col("page_id"))), F.lit(f"WARC-Record-ID: <{RECORD_ID}>")),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.lit("sha1:"), base32(F.col("sha1"))),
        line("WARC-Block-Digest", F.lit("sha1:"), base32(F.sha1(F.encode("block", "UTF-8")))),
        F.when(F.col("revisit"), line("WARC-Refers-To", identity(F.col("first_id")))),
        F.when(
            F.col("revisit"),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.select(F.concat(head, F.lit(CRLF + CRLF), F.col("block")).alias("value"))


def _members(batches):
    """Rows of one gzip member each, without its last byte, which the writer's line end gives."""

    def packed(parts):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = b"".join([*(pack.compress(x) for x in parts), pack.flush()])
        if data[-1]:  # the length's highest byte: 16 MB or more, so an empty member ends the row
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            data += pack.compress(b"") + pack.flush()
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["member"])

    parts, held = [], 0
    for batch in batches:
        for value in batch.column("value"):
            record = value.as_py().encode() + b"\r\n\r\n"
            if parts and held + len(record) > MEMBER_BYTES:
                yield packed(parts)
                parts, held = [], 0
            parts.append(record)
            held += len(record)
    if parts:
        yield packed(parts)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, packed: bool = True) -> None:
    """Archives below ``path`` by Spark's text writer.

    In a plain archive the end of a WARC record is the writer's line end. A packed one is a row of
    gzip members of ``MEMBER_BYTES`` at most, or of one longer record: each is a place to read on
    from after damage. A member ends with the highest byte of its length, a zero: the line end.
    """
    rows = records(pages, least_bytes)
    if packed:
        rows = rows.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    (
        rows.write.option("lineSep", "\0" if packed else CRLF + CRLF)
        .option("compression", "none")
        .option("maxRecordsPerFile", FILE_MEMBERS if packed else FILE_RECORDS).text(path)
    )


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError if a check fails."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise ValueError("no end of header")
    lines = data[at:head].decode("utf-8", "replace").split(CRLF)[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("no length")
    start = head + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length doesn't lead to the end of the record")
    block = data[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != _digest(block):
        raise ValueError("block digest differs")
    return headers, block, end + 4


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, its end, and what is wrong with it. Of a damaged
    member comes what can be unpacked."""
    unpack, parts, view = zlib.decompressobj(31), [], memoryview(data)
    for start in range(at, len(data), 1 << 16):
        before = unpack.copy()
        try:
            parts.append(unpack.decompress(view[start : start + (1 << 16)]))
        except zlib.error as error:
            for k in range(start, min(start + (1 << 16), len(data))):  # byte by byte up to the damage
                try:
                    parts.append(before.decompress(view[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(parts), len(data), f"gzip: {error}"
        if unpack.eof:
            end = min(start + (1 << 16), len(data)) - len(unpack.unused_data)
            return b"".join(parts), end, None
    return b"".join(parts), len(data), "gzip: member is cut"


Found = tuple[int, int, dict[str, str] | None, bytes, str | None]


def _walk(data: bytes, packed: bool) -> Iterator[Found]:
    at, gap, reason = 0, None, ""
    start = _START if packed else _VERSION
    while at < len(data):
        found: list[Found] = []
        try:
            if not start.match(data, at):
                raise ValueError("no start of a record")
            if data[at] == 0x1F:
                inner, end, wrong = _unpacked(data, at)
                found = [(at, 0, h, b, r and f"in member: {r}") for _, _, h, b, r in _walk(inner, False)]
                if not inner and not wrong:  # an empty member: the end of a row of ``write_warc``
                    if gap is None:
                        at = end
                        continue
                    raise ValueError("gzip: no record inside")
                if wrong:
                    found = [x for x in found if x[2] is not None]
                    raise ValueError(wrong)
                if not any(x[2] is not None for x in found):
                    found = []
                    raise ValueError("gzip: no record inside")
                found[0] = (at, end - at, *found[0][2:])
            else:
                headers, block, end = _record(data, at)
                found = [(at, end - at, headers, block, None)]
        except ValueError as error:
            if gap is None:
                gap, reason = at, str(error)
            yield from found
            later = start.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", reason
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", reason


def salvage(data: bytes) -> Iterator[Found]:
    """(offset, length, headers, block, None) of records and (offset, length, None, b"", reason) of gaps.

    After a failed check the search goes on at the next version line or member start that leads to
    a whole record; the bytes up to there are one gap. A gzip member holds one record or more: its
    length is on the first of them, and whole records of a damaged one are kept.
    """
    yield from _walk(data, True)


READ = (
    "file string, offset long, length long, gap string, type string, record_id string, target_uri string,"
    " refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def _read(batches):
    columns = [c.strip().split()[0] for c in READ.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.strip().split()[0], kinds[c.strip().split()[1]]) for c in READ.split(",")])
    for batch in batches:
        for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, held = [], 0
            for offset, length, headers, block, gap in salvage(data.as_py() or b""):
                if headers is None:
                    rows.append((file, offset, length, gap, *[None] * 7))
                else:
                    rows.append((file, offset, length, None, *_shown(headers, block)))
                held += length
                if held > 8 << 20:
                    yield _batch(rows, columns, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, columns, schema)


def _batch(rows, columns, schema):
    return pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows)))), schema=schema)


def _shown(headers: dict[str, str], block: bytes):
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    digest, size = _digest(payload), len(payload)
    if headers.get("warc-type") == "revisit":  # the payload that it refers to
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size = int(stated[1]) if stated else None
    bare = lambda name: headers.get(name, "").strip("<>") or None
    return (
        headers.get("warc-type"), bare("warc-record-id"), headers.get("warc-target-uri"), bare("warc-refers-to"),
        digest, size, payload,
    )


def _found(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, READ)


def read_warc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and quarantined gaps (file, offset, length, reason) of all archives at ``path``.

    Plain archives and gzip members of one record or more; a file may hold both. A file is
    read whole by one task: archives are expected to be bounded, as ``write_warc`` bounds them.
    An empty file has neither records nor gaps.
    """
    found = _found(spark, path)
    gaps = found.where("gap is not null").select("file", "offset", "length", F.col("gap").alias("reason"))
    return found.where("gap is null").drop("gap"), gaps


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` and return what their records say, one row for each page.

    A gap that damage left has a row too: record_type is ``gap`` and payload_bytes its length in the file.
    """
    stages = Stages(pages.sparkSession, "warc")
    path = stages.place("archives")
    write_warc(pages, path, least_bytes)
    found = _found(pages.sparkSession, path)
    number = lambda c: F.regexp_extract(c, RECORD_ID + r"(-?\d+)$", 1).try_cast("long")
    return found.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(F.col("gap").isNull(), F.col("payload_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        "payload_digest",
        F.when(F.col("gap").isNull(), F.col("type")).otherwise("gap").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )
