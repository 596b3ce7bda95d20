"""WARC archives of pages: a writer with revisit records, and a salvage reader.

Writer: pages with equal payloads (the html's UTF-8 bytes) are one group, told by SHA-1 and a second hash; the one with the
largest page id is written as a ``response``, the others as ``revisit`` records that refer to it and carry the HTTP head
alone, its Content-Length being that of the payload. Every record is a gzip member of its own. Spark's text writer puts
the members into files, so archives are committed like any table on any store and a lost executor's attempts leave none
behind; the line separator that it asks for is an empty gzip member, which readers skip.

Salvage reader: a file is read from its start, member by member, or record by record where it is not compressed. A
member must inflate to its end with the right checksum; a record must have a version line, a length that meets the end of
its block and, where given, the right digests of block and payload. After a failed check the reader searches the next gzip
magic or version line from which a record passes all of them, goes on there, and logs the bytes between as a gap. A gap's bytes are
given by file, start and end, so they can be looked at later; no record is given that failed a check.

A file is one row of Spark's binary source, so it is read by one task and must stay below 2 GB; the writer's files have
``RECORDS`` records at most and follow Spark's advisory size of partitions.

Defined cases: null html is an empty payload, null urls have no target, ids of any type are written as text; a null id is no
id, and smaller than any; rows that repeat the largest id of a group are all responses; payloads of any length are kept whole;
further columns are ignored; an empty table gives an empty folder, which reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, shared_path

VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, MAGIC, RECORDS, FEED = b"\r\n\r\n", b"\x1f\x8b\x08", 20_000, 1 << 16
#: Longest head of a record.
HEAD = 1 << 20
START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+$")


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member of its own, the same in every run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


SEPARATOR = member(b"")


# --- writer -----------------------------------------------------------------------------------
def name_of(page_id: object) -> str:
    return "urn:no-page" if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def page_of(name: str) -> str | None:
    return unquote(name.removeprefix("urn:page:")) if name.startswith("urn:page:") else None


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """One record with its head. Controls and spaces of a url are percent-encoded, as they would end the line."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name_of(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{name_of(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def _members(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, revisit, refers_to to members, some megabytes at a time."""
    for batch in batches:
        out, size = [], 0
        for page_id, url, html, revisit, refers_to in zip(*batch.columns, strict=True):
            payload = (html.as_py() or "").encode()
            out.append(member(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), revisit.as_py(), date)))
            size += len(out[-1])
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a record for each page; payloads of fewer than ``least_bytes`` bytes are all responses. Gives the folder's path."""
    require(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.xxhash64(html).alias("check"), F.octet_length(html).alias("size"))
    largest = rows.groupBy("sha", "check").agg(F.max("page_id").alias("largest"))
    joined = rows.join(largest, ["sha", "check"])
    revisit = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    members = joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))
    out = members.mapInArrow(partial(_members, date=date), "member binary").select(F.col("member").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(path)
    return path


# --- salvage reader ---------------------------------------------------------------------------
class Failed(Exception):
    """A check of a member or record that did not hold."""


def inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """The bytes of the member that begins here, and where it ends."""
    z, out, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if end >= len(data):
                raise Failed("member cut short")
            out.append(z.decompress(data[end : end + FEED]))
            end = min(end + FEED, len(data))
    except zlib.error as e:
        raise Failed("member does not inflate") from e
    return b"".join(out), end - len(z.unused_data)


def parsed(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Header fields, block and end of the record that begins here."""
    head = data.find(END, at, at + HEAD)
    if head < 0:
        raise Failed("no end of head")
    version, *lines = data[at:head].split(b"\r\n")
    if not _VERSION_LINE.match(version):
        raise Failed("no version line")
    try:
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    except UnicodeDecodeError as e:
        raise Failed("head is not UTF-8") from e
    if not re.fullmatch("[0-9]{1,18}", length := fields.get("content-length", "")):
        raise Failed("no length")
    begin, end = head + 4, head + 4 + int(length)
    block = data[begin:end]
    if len(block) < int(length) or data[end : end + 4] != END:
        raise Failed("length does not meet the record's end")
    return fields, block, end + 4


def checked(fields: dict, block: bytes) -> dict:
    """The record's columns once its digests hold."""
    said = lambda f: fields[f].removeprefix("sha1:") if fields.get(f, "").startswith("sha1:") else None
    if (block_digest := said("warc-block-digest")) and block_digest != digest(block):
        raise Failed("block digest")
    http, payload, size, kind = fields.get("content-type", "").startswith("application/http"), block, None, fields.get("warc-type")
    if http:
        head, found, payload = block.partition(END)
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head + b"\r\n")
        size = int(stated[1]) if stated else None
    if kind == "revisit":
        payload = None
    else:
        size = len(payload)
        if (payload_digest := said("warc-payload-digest")) and payload_digest != digest(payload):
            raise Failed("payload digest")
    name = lambda f: page_of(fields[f].strip("<>")) if f in fields else None
    return {
        "record_type": kind, "page_id": name("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": said("warc-payload-digest") or (digest(payload) if payload is not None else None), "refers_to": name("warc-refers-to"), "payload": payload,
    }


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) of all records that can be had, and (start, end, what failed) of the gaps between them, in order."""
    view, at, gap, why = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                raw, end = inflated(view, at)
                found = None
                if raw:
                    fields, block, last = parsed(raw, 0)
                    if last != len(raw):
                        raise Failed("member goes on behind its record")
                    found = checked(fields, block)
            elif data.startswith(b"WARC/", at):
                fields, block, end = parsed(data, at)
                found = checked(fields, block)
            else:
                raise Failed("no member or version line")
        except Failed as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            ahead = START.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
            continue
        if gap is not None:
            yield gap, at, why
            gap = None
        if found is not None:
            yield at, end, found
        at = end
    if gap is not None:
        yield gap, len(data), why


COLUMNS = {"file": pa.string(), "start": pa.int64(), "end": pa.int64(), "problem": pa.string(), "record_type": pa.string(), "page_id": pa.string(), "target_uri": pa.string()}
COLUMNS |= {"payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}


def _salvaged(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in COLUMNS.items()], names=list(COLUMNS))

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            out, size = [], 0
            for start, end, found in salvage(content.as_py()):
                row = {"problem": found} if isinstance(found, str) else found
                if not with_payload:
                    row.pop("payload", None)
                out.append({"file": path.as_py(), "start": start, "end": end, **row})
                size += 500 + len(row.get("payload") or b"")
                if size >= 1 << 22:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)


def read_archives(spark: SparkSession, path: str, id_type: str = "string", with_payload: bool = True) -> DataFrame:
    """Records and gaps of all files in a folder; gaps have a ``problem``, records none."""
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in COLUMNS.items())
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(partial(_salvaged, with_payload=with_payload), schema)
    return found.withColumns({n: F.col(n).cast(id_type) for n in ("page_id", "refers_to")})


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to a new folder of the shared one and read them back: a row for each record. The archives stay."""
    spark = pages.sparkSession
    path = write_archives(pages, shared_path(spark, "warc"), least_bytes)
    found = read_archives(spark, path, pages.schema["page_id"].dataType.simpleString(), with_payload=False)
    return found.where("problem is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
