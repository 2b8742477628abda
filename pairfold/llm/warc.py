"""Legacy web archives: ARC files are parsed by their version's header lines and converted to WARC records.

An ARC file begins with a version block that names the fields of its record header lines; version 1 has five, version 2
ten.  Each record is such a line, as many bytes as it declares, and a line feed.  The converter gives every record a WARC
type, an identifier that depends on its contents alone, a WARC-Date, and block and payload digests.  Of records with equal
payloads one stays a response, and the others become revisits of it.

Archives are files written by Spark's text source, which puts out bytes as they are: a row is a record, and the line
separator is what ends a record.  So they go to any file system that Spark knows, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfold.llm.common import attach, blocks, delete, forget, new_path, save

# The fields of the header lines of both versions, and WARC's profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# WARC's header of the address, and headers of our own for what version 2 says besides.
ARC_EXTRA = {"IP-address": "WARC-IP-Address", "Result-code": "ARC-Result-Code", "Checksum": "ARC-Checksum", "Location": "ARC-Location"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(name: str, date: str, version: int) -> bytes:
    """The record that begins an ARC file."""
    body = f"{version} 0 generator\n{ARC_FIELDS[version]}\n".encode()
    more = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body


def arc_record(url: str, ip: str, date: str, kind: str, body: bytes, version: int, status: int = 200, name: str = "-", offset: int = 0) -> bytes:
    """A record without its closing line feed; white space in the fields is percent-encoded."""
    field = lambda x: quote(x, safe="!#$%&'()*+,/:;=?@[]~") or "-"
    head = [field(url), field(ip), date, field(kind)]
    if version == 2:
        head += [str(status), base64.b16encode(hashlib.md5(body).digest()).decode().lower(), "-", str(offset), field(name)]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body


#: What a header line ends with: an address, a date and a length with fields between them.
_HEADER_LIKE = re.compile(rb"^\S.* [0-9a-fA-F:.]+ \d{4,14} .*\d+\r?\n?$")


def read_arc(stream, reject: Callable[[str, bytes], None] | None = None) -> Iterator[dict]:
    """Records of an ARC stream as dicts of their header fields and ``body``; a version block sets the fields from there on.

    Header lines are split from the right, so a URL may hold blanks.  Blank lines between records are passed over.  A header
    line with too few fields, without a length or without a date, and a body shorter than declared raise ValueError; with
    ``reject`` they are given to it, with the reason, and reading goes on after the record, or at the next line that looks
    like a header where the line doesn't tell how long the record is.
    """
    names = ARC_FIELDS[1].split()
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        first = line.startswith(b"filedesc:")
        fields = text.split(" ") if first else text.rsplit(" ", len(names) - 1)
        wrong = None
        if len(fields) < (4 if first else len(names)):
            wrong = f"a header line has {len(fields)} fields instead of {len(names)}"
        elif not fields[-1].isdecimal():
            wrong = "a header line has no length"
        if wrong:
            if not reject:
                raise ValueError(f"{wrong}: {line[:200]!r}")
            reject(wrong, line)
            continue_at = _next_header(stream)
            if continue_at is None:
                return
            stream = continue_at
            continue
        size = int(fields[-1])
        body = stream.read(size)
        record = {"URL": fields[0], "IP-address": fields[1], "Archive-date": fields[2], "Content-type": fields[3]} if first else dict(zip(names, fields, strict=True))
        if len(body) != size:
            wrong = f"{len(body)} bytes instead of {size}"
        elif warc_date(record["Archive-date"]) is None:
            wrong = f"no date: {record['Archive-date']}"
        if wrong:
            if not reject:
                raise ValueError(f"{record['URL']}: {wrong}")
            reject(wrong, line)
            continue
        if first:
            version, _, rest = body.partition(b"\n")
            names = rest.split(b"\n")[0].decode("utf-8", "surrogateescape").split()
            if names[-1:] != ["Archive-length"] or "URL" not in names[:1]:
                names = ARC_FIELDS[2 if version[:1] == b"2" else 1].split()
        yield record | {"body": body, "filedesc": first}


class _Pushed:
    """A stream with a line put back before it."""

    def __init__(self, line: bytes, stream) -> None:
        self.line, self.stream = line, stream.stream if isinstance(stream, _Pushed) else stream

    def readline(self) -> bytes:
        line, self.line = self.line, b""
        return line or self.stream.readline()

    def read(self, size: int) -> bytes:
        return self.stream.read(size)


def _next_header(stream) -> _Pushed | None:
    """The stream from the next line on that looks like a header; None at its end."""
    while line := stream.readline():
        if line.startswith(b"filedesc:") or _HEADER_LIKE.match(line):
            return _Pushed(line, stream)
    return None


def warc_date(arc_date: str) -> str | None:
    """ISO 8601 of an ARC date of 14 digits; of one cut short after a whole part, the beginning of that; None if it is no date."""
    if not re.fullmatch(r"\d{4}(\d\d){0,5}", arc_date):
        return None
    try:
        return datetime.strptime(arc_date + "00000101000000"[len(arc_date) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except ValueError:
        return None


def convert(record: dict) -> dict:
    """What WARC says of an ARC record: type, id, date, target, content type, digests, HTTP head and payload."""
    body, head = record["body"], b""
    if record["filedesc"]:
        kind, content = "warcinfo", "text/plain"
    elif body.startswith(b"HTTP/"):
        kind, content = "response", "application/http; msgtype=response"
        end = re.search(rb"\r?\n\r?\n", body)
        head = body[: end.end()] if end else body
    else:
        kind, content = "resource", record["Content-type"]
    payload = body[len(head) :]
    block = base32_sha1(body)
    date = warc_date(record["Archive-date"])
    return {
        "type": kind, "id": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{record["URL"]} {date} {block}')}>", "date": date, "uri": record["URL"],
        "content_type": content, "block_digest": block, "payload_digest": base32_sha1(payload), "head": head, "payload": payload,
        "extra": [(header, value) for field, header in ARC_EXTRA.items() if (value := record.get(field, "-")) != "-"],
    }


def warc_record(r: dict, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """A WARC record without the two line ends that close it; ``refers_to``: id, target and date of what it revisits."""
    block = r["head"] if refers_to else r["head"] + r["payload"]
    lines = [("WARC-Type", "revisit" if refers_to else r["type"]), ("WARC-Record-ID", r["id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"])]
    if refers_to:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to[0]), ("WARC-Refers-To-Target-URI", refers_to[1]), ("WARC-Refers-To-Date", refers_to[2])]
    lines += r.get("extra", [])
    lines += [("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", r["content_type"]), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block


def read_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{headers.get('warc-record-id')}: {len(block)} bytes instead of {size}")
        yield headers, block


def _open(content: bytes):
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _streams(batches):
    """An open stream for each archive; batches hold whole files, which the task reads one after the other."""
    for b in batches:
        for i in range(b.num_rows):
            yield _open(b.column(1)[i].as_py())


def _write(records: DataFrame, path: str, end: str) -> None:
    """Write rows of one binary column as they are, each followed by ``end``, in gzip files."""
    text = records.select(F.col(records.columns[0]).cast("string").alias("value"))
    text.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", end).text(path)


def _rows(rows, schema: pa.Schema, limit: int = 4 << 20):
    """Batches of about ``limit`` bytes of rows (tuples)."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 200
        if size >= limit:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


#: Within an archive a page is known by its target alone, so its id is a part of that.
_PAGE = re.compile(r"[#&]page-id=(-?\d+|null)$")


def _target(page_id: int | None, url: str | None) -> str:
    url = url or "urn:page"
    return f"{url}{'&' if '#' in url else '#'}page-id={'null' if page_id is None else page_id}"


def _page_of(uri: str) -> int | None:
    m = _PAGE.search(uri)
    return int(m[1]) if m and m[1] != "null" else None


def write_arc(pages: DataFrame, path: str, version: int | None = None, date: str = "20240101000000", ip: str = "0.0.0.0", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as ARC files, one for each task: HTTP responses with the html in UTF-8 (null: empty).

    ``version`` is 1 or 2, or None for files of version 1 and 2 by turns.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        v = version or 1 + part % 2
        name = f"part-{part:05d}.arc"

        def records():
            at = 0
            for ids, urls, pages in blocks(batches, ["id", "url", "html"]):
                for i, url, page in zip(ids, urls, pages, strict=True):
                    if not at:
                        at = len(first := arc_version_block(name, date, v)) + 1
                        yield (first,)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(page)}\r\n\r\n".encode()
                    record = arc_record(_target(i, url), ip, date, "text/html", head + page, v, name=name, offset=at)
                    at += len(record) + 1
                    yield (record,)

        yield from _rows(records(), pa.schema([("record", pa.binary())]))

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    _write(rows.mapInArrow(run, "record binary"), path, "\n")


def arc_rejects(spark: SparkSession, arc: str) -> DataFrame:
    """(path, reason, line) of the records of ARC files that can't be converted."""

    def run(batches):
        for b in batches:
            for path, content in zip(*(b.column(c).to_pylist() for c in (0, 1)), strict=True):
                found: list[tuple[str, str, bytes]] = []
                for _ in read_arc(_open(content), lambda why, line, path=path, found=found: found.append((path, why, line))):
                    pass
                yield from _rows(found, pa.schema([("path", pa.string()), ("reason", pa.string()), ("line", pa.binary())]))

    return _files(spark, arc).mapInArrow(run, "path string, reason string, line binary")


def convert_arc(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Convert all ARC files of a folder to WARC files.

    Records that can't be converted are left out; :func:`arc_rejects` tells which they are.

    Of responses with equal payloads of at least ``min_bytes`` bytes, that with the largest page id (then target) stays a
    response, and the others become revisits.  Other records keep the type that they have.
    """

    def parsed(whole: bool):
        def run(batches):
            def rows():
                for stream in _streams(batches):
                    for r in map(convert, read_arc(stream, lambda why, line: None)):
                        if r["type"] == "response" and len(r["payload"]) >= min_bytes:
                            key = r["payload_digest"]
                        else:
                            key = None
                        full = len(r["head"]).to_bytes(8, "little") + r["head"] + r["payload"] if whole else None
                        yield key, r["id"], r["uri"], r["date"], r["type"], _page_of(r["uri"]), r["content_type"] if whole else None, full, json.dumps(r["extra"]) if whole else None

            yield from _rows(rows(), pa.schema([("key", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("type", pa.string()), ("page", pa.int64()), ("content_type", pa.string()), ("record", pa.binary()), ("extra", pa.string())]))

        return _files(spark, arc).mapInArrow(run, "key string, id string, uri string, date string, type string, page long, content_type string, record binary, extra string")

    order = F.struct(F.coalesce("page", F.lit(-(1 << 63))), "uri", "id")
    first = F.max(F.struct(order.alias("o"), "id", "uri", "date")).alias("first")
    groups = parsed(False).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), first).where("n > 1")
    groups = save(groups.select("key", "n", *[F.col(f"first.{c}").alias(f"to_{c}") for c in ("id", "uri", "date")]), "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    rows = attach(parsed(True), groups, "key", "n", total, F.col("id"))

    def run(batches):
        def records():
            for key, i, uri, date, kind, content, full, extra, a, b, c in (x for cols in blocks(batches, ["key", "id", "uri", "date", "type", "content_type", "record", "extra", "to_id", "to_uri", "to_date"]) for x in zip(*cols, strict=True)):
                cut = 8 + int.from_bytes(full[:8], "little")
                r = {"type": kind, "id": i, "uri": uri, "date": date, "content_type": content, "head": full[8:cut], "payload": full[cut:], "extra": json.loads(extra)}
                r["payload_digest"] = key or base32_sha1(r["payload"])
                yield (warc_record(r, (a, b, c) if a is not None and a != i else None),)

        yield from _rows(records(), pa.schema([("record", pa.binary())]))

    _write(rows.mapInArrow(run, "record binary"), warc, "\r\n\r\n")
    forget(groups)


def read_pages(spark: SparkSession, warc: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages in WARC files.

    Sizes and digests of revisits are those of the full payload: the size is what their HTTP head declares.
    """

    def run(batches):
        def rows():
            for stream in _streams(batches):
                for h, block in read_warc(stream):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    end = re.search(rb"\r?\n\r?\n", block)
                    head = block[: end.end()] if end else block
                    if h["warc-type"] == "revisit":
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        to = _page_of(h["warc-refers-to-target-uri"])
                    else:
                        payload = block[len(head) :]
                        size, digest, to = len(payload), base32_sha1(payload), None
                        if h["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"{h['warc-record-id']}: another payload than its digest's")
                    yield _page_of(h["warc-target-uri"]), size, digest, h["warc-type"], to

        yield from _rows(rows(), pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return _files(spark, warc).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def through_archives(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Pages written as ARC files, converted to WARC files, and read back from those; see :func:`read_pages`.

    A null html is empty, and so equal to an empty one; a null url becomes ``urn:page``.  Rows with a null page id stay
    rows, and refer or are referred to by null.  Rows that repeat id, url and html are one record written twice, both
    responses if they are the one that stays.  An empty table gives no rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, **columns)
    convert_arc(spark, arc, warc, min_bytes)
    delete(spark, arc)
    return read_pages(spark, warc)
