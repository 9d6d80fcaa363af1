"""WARC archives: a writer of gzip members with revisit records, and a salvaging reader.

An archive is a run of gzip members, one record in each. Archives are kept as rows (archive,
content): Spark commits them as a whole, so lost executors leave nothing half-written, and
`spark.read.format("binaryFile")` gives rows of the same kind for real files.

The reader checks every member (gzip's own sum), version line, header block, length and
block digest. Where a check fails it looks for the next place at which a member (1f 8b 08)
or a version line (WARC/1.) begins and goes on there if a record can be read; the bytes
between are logged as a quarantined gap. Uncompressed archives are read as well. A member that
is cut short or damaged gives what it inflates to before its error, but for a record that ends just
where the inflated bytes do; the bytes of a member are
salvaged by version lines as those of an archive are, and its gaps, which lie in the inflated
bytes, are logged with the place of the member.

Payloads: null is empty. Of records with equal payloads the one with the greatest page id is
the response (every row of that id, if the row is repeated), the others are revisits of it
without a body. Rows without a page id are responses. Payloads below `revisit_from` bytes
are always responses. Very long payloads are one record each, whose archive closes behind it.
An empty table gives no archive. Extra columns are not read, whatever their names.

Only payloads that occur more than once are looked up: their digests are counted first, so a
page is written where it is read. Beyond `broadcast_rows` such payloads the pages are joined with
them by digest, and adaptive execution splits a digest that many pages have.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.scratch import Scratch
from lectern.llm.textarrays import bounded_batches

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
FEED = 1 << 14


@dataclass(frozen=True)
class Settings:
    """archive_bytes: an archive is closed when it has so many. revisit_from: least payload that may be a revisit.

    broadcast_rows: at most so many repeated payloads are broadcast, about 60 bytes each.
    """

    broadcast_rows: int = 500_000
    archive_bytes: int = 1 << 20
    revisit_from: int = 0
    level: int = 6
    date: str = "2000-01-01T00:00:00Z"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    """start and end are places in the archive; of a gap inside a member, in its inflated bytes, and member is where that begins."""

    start: int
    end: int
    reason: str
    member: int | None = None


def base32_sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def _value(text: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text).strip()


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {_value(v)}\r\n" for k, v in lines).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with the payload, or a revisit of the page refers_to with the HTTP headers only."""
    name = "urn:page:none" if page_id is None else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return build_record(headers, http)
    return build_record(headers, http + payload)


class Broken(ValueError):
    pass


def parse_record(content: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at `at` in plain bytes, and where it ends."""
    if not content.startswith(b"WARC/1.", at):
        raise Broken("no version line")
    close = content.find(b"\r\n\r\n", at)
    if close < 0:
        raise Broken("headers do not end")
    headers: dict[str, str] = {}
    for line in content[at:close].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Broken("not a header line")
        headers[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdecimal():
        raise Broken("no length")
    begin, size = close + 4, int(headers["content-length"])
    block = content[begin : begin + size]
    if len(block) < size or content[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise Broken("the block does not end at its length")
    digest = headers.get("warc-block-digest")
    if digest and digest.removeprefix("sha1:") != base32_sha1(block):
        raise Broken("block digest differs")
    return Record(headers, bytes(block)), begin + size + 4


def _inflated(content: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at `at` inflates to, where it ends, and its error or an empty string."""
    unpacker, plain, place = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and place < len(content):
            chunk = content[place : place + FEED]
            before = unpacker.copy()
            try:
                plain.append(unpacker.decompress(chunk))
            except zlib.error:
                # a byte at a time, as what a call has inflated is lost with its error
                for k in range(len(chunk)):
                    plain.append(before.decompress(chunk[k : k + 1]))
                raise
            place += FEED
    except zlib.error as e:
        return b"".join(plain), at, f"gzip: {e}"
    if not unpacker.eof:
        return b"".join(plain), at, "gzip: the member does not end"
    return b"".join(plain), min(place, len(content)) - len(unpacker.unused_data), ""


def _salvage_plain(plain: bytes, member_at: int) -> Iterator[Record | Gap]:
    at, bad_from, reason = 0, None, ""
    while at < len(plain):
        try:
            record, end = parse_record(plain, at)
        except Broken as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            at = plain.find(b"WARC/1.", at + 1)
            at = len(plain) if at < 0 else at
            continue
        if bad_from is not None:
            yield Gap(bad_from, at, reason, member_at)
            bad_from = None
        yield record
        at = end
    if bad_from is not None:
        yield Gap(bad_from, len(plain), reason, member_at)


def _read_at(content: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """What can be read at `at`, where it ends, and the error that a member ends with, or an empty string."""
    if content.startswith(MAGIC, at):
        plain, end, error = _inflated(content, at)
        found = list(_salvage_plain(plain, at))
        if error and found and isinstance(found[-1], Record):
            found.pop()
        if not any(isinstance(x, Record) for x in found):
            raise Broken(error or (found[0].reason if found else "an empty member"))
        return found, end, error
    record, end = parse_record(content, at)
    return [record], end, ""


def _next_start(content: bytes, at: int) -> int:
    places = [p for p in (content.find(MAGIC, at), content.find(b"WARC/1.", at)) if p >= 0]
    return min(places, default=len(content))


def salvage(content: bytes) -> Iterator[Record | Gap]:
    """All records that can be read, in order, and the gaps between them."""
    at, bad_from, reason = 0, None, ""
    while at < len(content):
        try:
            found, end, error = _read_at(content, at)
        except Broken as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            at = _next_start(content, at + 1)
            continue
        if bad_from is not None:
            yield Gap(bad_from, at, reason)
            bad_from = None
        yield from found
        if error:
            bad_from, reason = at, error
            at = _next_start(content, at + 1)
        else:
            at = end
    if bad_from is not None:
        yield Gap(bad_from, len(content), reason)


def planned(pages: DataFrame, settings: Settings) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumns({"size": F.octet_length("html"), "digest": F.unhex(F.sha1(F.encode("html", "UTF-8")))})
    times = keyed.select("page_id", "digest", "size").groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("times"))
    repeated = Scratch(pages.sparkSession, "payloads").keep(times.where("times > 1").select("digest", "size", "last"), "repeated")
    few = repeated.limit(settings.broadcast_rows + 1).count() <= settings.broadcast_rows
    refers = F.when((F.col("size") >= settings.revisit_from) & (F.col("page_id") < F.col("last")), F.col("last"))
    return keyed.join(F.broadcast(repeated) if few else repeated, ["digest", "size"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(archive, content) rows with a record for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, refers = (batch.column(j)[k].as_py() for j in range(4))
                members.append(member(page_record(page_id, url, html.encode(), refers, settings.date), settings.level))
                size += len(members[-1])
                if size >= settings.archive_bytes:
                    yield closed()
                    number, members, size = number + 1, [], 0
        if members:
            yield closed()

    return bounded_batches(planned(pages, settings)).mapInArrow(run, "archive string, content binary")


READ = "archive string, kind string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, gap_start long, gap_end long, reason string"


def _page_number(name: str) -> int | None:
    digits = name.strip("<>").removeprefix("urn:page:")
    return int(digits) if digits.lstrip("-").isdecimal() else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of kind `record` for every record, and of kind `gap` for every quarantined range of bytes.

    archives: (archive, content), or binaryFile's (path, content). payload is null for
    revisits, and everywhere if payloads is false.
    """
    name = "archive" if "archive" in archives.columns else "path"
    wanted = to_arrow_schema(T.StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                archive, content, out = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b"", []
                for found in salvage(content):
                    row = {"archive": archive}
                    if isinstance(found, Gap):
                        row |= {"kind": "gap", "gap_start": found.start, "gap_end": found.end, "reason": found.reason if found.member is None else f"in the bytes of the member at {found.member}: {found.reason}"}
                    else:
                        h = found.headers
                        head, _, body = found.block.partition(b"\r\n\r\n")
                        sizes = [line.partition(b":")[2].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
                        revisit = h.get("warc-type") == "revisit"
                        row |= {"kind": "record", "page_id": _page_number(h.get("warc-record-id", "")), "record_type": h.get("warc-type"), "url": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                        row |= {"payload_bytes": int(sizes[0]) if sizes and sizes[0].isdigit() else len(body), "refers_to": _page_number(h["warc-refers-to"]) if "warc-refers-to" in h else None, "payload": body if payloads and not revisit else None}
                        if not revisit and row["payload_digest"] not in (None, base32_sha1(body)):
                            row["reason"] = "payload digest differs"
                    out.append(row)
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, wanted)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, wanted)

    return bounded_batches(archives).select(name, "content").mapInArrow(run, READ)
