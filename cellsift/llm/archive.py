"""Legacy archives: ARC files of both versions, read by their declared lengths and turned into WARC records.

WARC files hold a gzip member for each record, so that readers can seek to one, and are written by Spark's
own text writer on any file system: an empty gzip member stands between two records, which readers of
gzip skip.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_rows, new_path, part_of, salted_parts, spread_join, table

#: The header line's fields by version, as the version block states them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payload bytes that a WARC file holds, about; a larger page has one for itself.
FILE_BYTES = 256 << 20
PIECE = 1 << 20
END = b"\r\n\r\n"
#: An empty gzip member, between two records.
GAP = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def quoted(url: str) -> str:
    """A URL for a header line: nothing that splits it."""
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"


def arc_head(version: int, url: str, ip: str, date: str, mime: str, size: int, name: str, offset: int) -> bytes:
    if version == 1:
        head = [quoted(url), ip, date, mime]
    else:
        head = [quoted(url), ip, date, mime, "200", "-", "-", str(offset), name]
    return f"{' '.join([*head, str(size)])}\n".encode()


def arc_file(version: int, records: list[tuple[str, str, str, str, list[bytes]]], name: str) -> bytearray:
    """An ARC file: the version block, then (url, ip, 14-digit date, mime, parts of the body) each."""
    block = f"{version} 0 cellsift\n{ARC_FIELDS[version]}\n\n".encode()
    out = bytearray()
    for url, ip, date, mime, body in [(f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", [block]), *records]:
        out += arc_head(version, url, ip, date, mime, sum(map(len, body)), name, len(out))
        for part in body:
            out += part
        out += b"\n"
    return out


def read_arc(data: bytes | bytearray) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields and body of each record; the first one's body says which fields follow the URL."""
    at, names, view = 0, None, memoryview(data)
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        size = int(line.rpartition(" ")[2])
        body = view[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError(f"record at {at} is cut off: {len(body)} of {size} bytes")
        if names is None:
            names = bytes(body).decode("ascii").split("\n")[1].split()
            values = line.rsplit(" ", ARC_FIELDS[1].count(" ") if len(line.split(" ")) < len(names) else len(names) - 1)
            values = [*values[:-1], *["-"] * (len(names) - len(values)), values[-1]]
        else:
            values = line.rsplit(" ", len(names) - 1)
        yield dict(zip(names, values, strict=True)), body
        at = end + 1 + size


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso(date: str) -> str:
    d = (date + "0101000000"[max(0, len(date) - 4) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_head(fields: list[tuple[str, str]], size: int) -> str:
    return "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(size))])


def record_id(url: str, date: str, page_id: str, digest: str) -> str:
    """Follows from the record's page, so that converting again gives the same archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id} {digest}')}>"


def to_warc(fields: dict[str, str], body: bytes | memoryview, refers: dict[tuple[str, str], tuple[str, str]], first: bool = False) -> tuple[bytes, bytes | memoryview]:
    """The head and block of an ARC record as a WARC record.

    first: it is the ARC file's description. refers: for the revisits, by page id and payload digest, the
    page id and URL of the response whose payload they repeat.
    """
    url, date = fields["URL"], iso(fields["Archive-date"])
    if first:
        text = f"software: cellsift\r\nconverted-from: {url}\r\nformat: WARC File Format 1.1\r\n".encode()
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(url, date, "", sha1_32(body))), ("WARC-Date", date), ("WARC-Block-Digest", f"sha1:{sha1_32(text)}"), ("Content-Type", "application/warc-fields")]
        return b"WARC/1.1\r\n" + warc_head(head, len(text)).encode() + b"\r\n", text
    http = re.match(rb"HTTP/\d", body)
    end = re.search(END, body) if http else None
    cut = end.end() if end else 0
    payload = body[cut:]
    digest = sha1_32(payload)
    page = re.search(rb"(?m)^X-Page-Id: (.*?)\r$", body[:cut])
    page_id = page[1].decode() if page else ""
    head = [("WARC-Type", "response" if http else "resource"), ("WARC-Record-ID", record_id(url, date, page_id, digest)), ("WARC-Date", date)]
    head += [("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("X-Page-Id", page_id)]
    if (page_id, digest) in refers:
        to, at = refers[page_id, digest]
        head[0], body = ("WARC-Type", "revisit"), body[:cut]
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(at, date, to, digest)), ("WARC-Refers-To-Target-URI", at), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", to)]
    head += [("WARC-Block-Digest", f"sha1:{sha1_32(body)}"), ("Content-Type", "application/http; msgtype=response" if http else fields["Content-type"])]
    return b"WARC/1.1\r\n" + warc_head(head, len(body)).encode() + b"\r\n", body


def member(*parts: bytes | memoryview) -> bytes:
    """A gzip member of the parts."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([*(pack.compress(p) for p in parts), pack.flush()])


def inflated(data: bytes) -> Iterator[bytes]:
    """All members of a gzip file, in pieces; bytes that aren't gzip as they are."""
    view, at = memoryview(data).cast("B"), 0
    while at < len(view):
        if view[at : at + 2] != b"\x1f\x8b":
            yield bytes(view[at:])
            return
        d = zlib.decompressobj(31)
        while not d.eof:
            chunk = d.unconsumed_tail or view[at : at + PIECE]
            if not d.unconsumed_tail:
                at += len(chunk)
                if not len(chunk):
                    raise ValueError("the last member is cut off")
            if got := d.decompress(chunk, PIECE):
                yield got
        at -= len(d.unused_data)


class Pieces:
    """Bytes that come in pieces, read by marks and lengths."""

    def __init__(self, source: Iterable[bytes]):
        self.source, self.held = iter(source), b""

    def more(self) -> bool:
        got = next(self.source, None)
        self.held += got or b""
        return got is not None

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise ValueError(f"{size} bytes are missing")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is skipped; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("the last record's head is cut off")
                return None
        got, self.held = self.held[:at], self.held[at + len(mark) :]
        return got


def records(source: Iterable[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Header fields and pieces of the block of each record, by the declared lengths; pieces left over are skipped."""
    data = Pieces(source)
    while (raw := data.until(END)) is not None:
        version, *lines = raw.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:20]!r}")
        head = dict(x.split(": ", 1) for x in lines)
        block = data.take(int(head["Content-Length"]))
        yield head, block
        for _ in block:
            pass
        if b"".join(data.take(4)) != END:
            raise ValueError(f"{head['WARC-Record-ID']} does not end where it says")


def read_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Header fields and whole block of each record."""
    return [(head, b"".join(block)) for head, block in records([data])]


def payload_of(block: Iterator[bytes]) -> tuple[int, str]:
    """Length and digest of what follows the HTTP head."""
    data, total, size = Pieces(block), hashlib.sha1(), 0
    data.until(END)
    while data.held or data.more():
        total.update(data.held)
        size += len(data.held)
        data.held = b""
    return size, base64.b32encode(total.digest()).decode()


def payload_column():
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, sum, refers_to, refers_url of the payloads that a smaller page_id has."""
    sums = pages.where("page_id IS NOT NULL").select("page_id", "url", F.octet_length(payload_column()).alias("n"), F.unhex(F.sha1(payload_column())).alias("sum")).where(F.col("n") >= least_bytes)
    first = sums.groupBy("sum").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).where("last > first.page_id")
    first = first.select("sum", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    return spread_join(sums.select("page_id", "sum").distinct(), first, "sum", part_of("page_id")).where("page_id > refers_to")


def address(page: int | None, url: str | None) -> str:
    return quoted(url or f"urn:page:{page}")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes gzipped WARC files, a record for each page (and one that describes each converted file).

    Every batch of pages goes through ARC files of version 1 (even ids) and 2 (odd or null ids) first, as
    an old archive would hold them. A null html is an empty payload, a null url a urn of the page's id.
    Rows are revisits by page_id and payload: of rows with equal ids each payload is judged for itself, and
    rows equal in both are all responses or all revisits; a null page_id is never a revisit. Payloads under
    least_bytes bytes are not revisited. Files hold about FILE_BYTES of payload; a record is held in memory
    about three times, never a file. Extra columns are ignored, an empty table gives no records.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    whole = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(salted_parts(spark), -(-whole // FILE_BYTES))
    rows = pages.withColumn("sum", F.unhex(F.sha1(payload_column()))).repartition(files, "page_id", "sum")
    rows = rows.join(revisits(pages, least_bytes), ["page_id", "sum"], "left")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            old: dict[int, list] = {1: [], 2: []}
            known, none = {}, pa.py_buffer(b"")
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "sum", "refers_to", "refers_url"))
            for page, url, digest, to, at, html in zip(*columns, batch.column("html"), strict=True):
                name = "" if page is None else str(page)
                if to is not None:
                    known[name, base64.b32encode(digest).decode()] = (str(to), address(to, at))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {name}\r\n\r\n"
                old[2 if page is None or page % 2 else 1].append((address(page, url), "127.0.0.1", "20200101000000", "text/html", [head.encode(), memoryview(html.as_buffer() if html.is_valid else none).cast("B")]))
            out = []
            for v, held in old.items():
                if held:
                    arc = arc_file(v, held, f"batch-v{v}.arc")
                    out += [member(*to_warc(f, b, known, first=not i), END) for i, (f, b) in enumerate(read_arc(arc))]
            return {"value": out}

        return step

    lines = map_rows(rows, make, "value binary").select(F.col("value").cast("string"))  # bytes as they are
    lines.write.option("lineSep", GAP.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages' records.

    Digests are computed again where the payload is there. Records are read in pieces; a file's compressed
    bytes are held.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for data in batch.column("content"):
                for head, block in records(inflated(data.as_buffer())):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (size, digest) != payload_of(block):
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not the one that was written")
                    refers = head.get("X-Refers-To-Page-Id")
                    for k, x in zip(out, (int(p) if (p := head["X-Page-Id"]) else None, size, digest, head["WARC-Type"], int(refers) if refers else None), strict=True):
                        out[k].append(x)
            return out

        return step

    return map_rows(files, make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warcs(spark, path)


ORACLE_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST(('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest
  FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f ON d.payload_digest = f.payload_digest
"""
