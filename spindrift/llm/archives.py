"""Legacy archive converter (operator 7): ARC files of either version into WARC records, and back to rows.

Archives travel as ``(path, content)`` rows, the shape of Spark's ``binaryFile`` source; gzipped ones, member
by member or whole, are opened. WARC files are written by Spark's own text writer (an atomic commit, nothing on
a machine-local disk): a row is a whole file of bounded size, whose bytes are written as they are, and the line
separator is the blank-line pair that ends the last record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hub_join, shared_dir, table

#: Bytes after which an ARC and a WARC file end (a longer record has a file of its own).
ARCHIVE_BYTES = 8 << 20
WARC_BYTES = 8 << 20
#: Revisits (about 100 bytes each) up to which their list is broadcast; a longer one is joined by a shuffle.
REVISITS = 400_000
# The field lists of the two ARC versions.
FIELDS = {
    "1": ("url", "ip", "date", "content_type", "length"),
    "2": ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "path string, position long, version string, url string, ip string, date string, content_type string, result_code string, filename string, payload_bytes long, payload_digest string, payload binary"
_HTTP = re.compile(rb"HTTP/\d[^\n]*\n(?:[^\r\n][^\n]*\n)*\r?\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_header(version: str, created: str = "20240101000000") -> bytes:
    """The version block that opens an ARC file; its declared length covers the two lines after its own."""
    body = f"{version} 0 spindrift\n{NAMES[version]}\n\n".encode()
    tail = "" if version == "1" else " 200 - - 0 archive"
    return f"filedesc://archive.arc 0.0.0.0 {created} text/plain{tail} {len(body)}\n".encode() + body + b"\n"


def http_head(size: int, kind: str = "text/html; charset=UTF-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {size}\r\n\r\n".encode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head that a record begins with (empty if there's none) and the payload after it."""
    m = _HTTP.match(block)
    return (m[0], block[m.end() :]) if m else (b"", block)


def opened(content: bytes) -> bytes:
    """The bytes of an archive, unpacked if it is gzipped; members follow one another."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out += [one.decompress(content), one.flush()]
        content = one.unused_data
    return b"".join(out)


def arc_record(version: str, url: str, payload: bytes, name: str, date: str = "20240101000000", kind: str = "text/html") -> bytes:
    """One ARC record: the header line of its version, then as many bytes as it declares."""
    url = quote(url or "-", safe=":/?&=#%~+,;@!$'()*[]-._") or "-"
    middle = "" if version == "1" else f" 200 - - 0 {quote(name, safe='') or '-'}"
    return f"{url} 0.0.0.0 {date} {kind}{middle} {len(payload)}\n".encode() + payload + b"\n"


def read_arc(content: bytes) -> Iterator[dict]:
    """Records of one ARC file. The version block names the version, the version names the fields.

    Payloads are taken by declared length, never by looking for the next header; stray newlines between
    records are skipped. A header with other fields than its version has, a length that isn't a number or
    that runs past the file raises ValueError.
    """
    at, version = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r").decode("utf-8", "replace")
        parts = line.split(" ")
        if version is None:
            if not line.startswith("filedesc://"):
                raise ValueError(f"no version block: {line[:80]!r}")
            first = content[end + 1 : end + 2].decode("ascii", "replace")
            if first not in FIELDS:
                raise ValueError(f"unknown version {first!r}")
            version = first
        names = FIELDS[version]
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"bad header at {at}: {line[:80]!r}")
        row, size = dict(zip(names, parts)), int(parts[-1])
        start = end + 1
        if start + size > len(content):
            raise ValueError(f"record at {at} declares {size} bytes; {len(content) - start} are left")
        if not line.startswith("filedesc://"):
            yield row | {"version": version, "position": at, "payload": content[start : start + size]}
        at = start + size


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _record(path: str, r: dict) -> tuple:
    payload = split_http(r["payload"])[1]
    return (path, r["position"], r["version"], r["url"], r["ip"], r["date"], r["content_type"], r.get("result_code"), r.get("filename"), len(payload), digest(payload), payload)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of ARC archives given as ``(path, content)``; version blocks give no row.

    A record that begins with an HTTP head has the bytes after it as its payload, another one all its bytes.
    Map-only. An empty archive (or null content) has no records. Digest: bare base32 SHA-1 of the payload;
    without ``payloads`` their column is left out. Other columns don't matter.
    """
    schema = RECORD if payloads else RECORD.rsplit(", ", 1)[0]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = [_record(path.as_py(), r) for r in read_arc(opened(content.as_py() or b""))]
                yield _batch(rows if payloads else [r[:-1] for r in rows], schema)

    return archives.select("path", "content").mapInArrow(parse, schema)


def pages_to_arc(pages: DataFrame, version: str = "2") -> DataFrame:
    """ARC archives ``(path, content)`` with a record for each ``(page_id, url, html)``, about 8 MiB each.

    A record is an HTTP head and the page. The page's id is the record's file name (version 2; "-" for a null
    id). Null html is an empty payload, a null url is "-". Paths name the input partition and a number.
    Repeated rows are records of their own; an empty table gives no archive.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, part, n = arc_header(version), TaskContext.get().partitionId(), 0
        held, size = [start], 0
        for batch in batches:
            for page, url, html in zip(*batch.columns):
                body = (html.as_py() or "").encode("utf-8", "surrogatepass")
                held.append(arc_record(version, url.as_py(), http_head(len(body)) + body, page.as_py() or "-"))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _batch([(f"{part}-{n}.arc", b"".join(held))], "path string, content binary")
                    held, size, n = [start], 0, n + 1
        if size:
            yield _batch([(f"{part}-{n}.arc", b"".join(held))], "path string, content binary")

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInArrow(pack, "path string, content binary")


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'spindrift:' + name)}>"


def warc_date(date: str) -> str:
    """ARC's 14 digits (or fewer) as a WARC timestamp."""
    d = ((date if date.isdigit() else "") + "19700101000000"[len(date) if date.isdigit() else 0 :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _block(kind: str, head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block


def warc_info(name: str) -> bytes:
    return _block("warcinfo", [f"WARC-Record-ID: {record_id('info ' + name)}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/warc-fields"], b"software: spindrift\r\nformat: WARC File Format 1.1\r\n")


def warc_record(path: str, r: dict, first: tuple[str, int, str] | None) -> bytes:
    """The WARC record of an ARC record, without the end lines; ``first``: path, position and name of the one it repeats.

    A record with an HTTP head is a response with the same block, one without is a resource; a revisit keeps
    the head alone. The id comes from path and position, so repeated names don't meet.
    """
    head, payload = split_http(r["payload"])
    block = r["payload"] if first is None else head
    kind = "revisit" if first else "response" if head else "resource"
    lines = [
        f"WARC-Record-ID: {record_id(f'{path} {r["position"]}')}",
        f"WARC-Date: {warc_date(r['date'])}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Source-Name: {r.get('filename', '-')}",
        f"Content-Type: {'application/http; msgtype=response' if head else r['content_type']}",
    ]
    if first:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(f'{first[0]} {first[1]}')}",
            f"X-Refers-To-Source-Name: {first[2]}",
        ]
    return _block(kind, lines, block)


def write_warc(archives: DataFrame, folder: str) -> None:
    """WARC files in ``folder`` from ``(path, content, again)``; each opens with a warcinfo record.

    ``again`` lists the revisits of an archive: ``position`` and, of the record repeated, ``path, at, name``.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, again in zip(*batch.columns):
                path, held, size, n = path.as_py(), [], 0, 0
                known = {x["position"]: (x["path"], x["at"], x["name"]) for x in again.as_py() or ()}
                for r in read_arc(opened(content.as_py() or b"")):
                    if not held:
                        held.append(warc_info(f"{path} {n}"))
                    held.append(warc_record(path, r, known.get(r["position"])))
                    size += len(held[-1])
                    if size >= WARC_BYTES:
                        yield _batch([(b"\r\n\r\n".join(held),)], "value binary")
                        held, size, n = [], 0, n + 1
                if held:
                    yield _batch([(b"\r\n\r\n".join(held),)], "value binary")

    rows = archives.select("path", "content", "again").mapInArrow(files, "value binary")
    text = rows.select(F.col("value").cast("string").alias("value"))  # the same bytes, whatever they are
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def read_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record of one WARC file, by declared length."""
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(head["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at {at} declares {size} bytes; {len(block)} are left")
        yield head, block
        at = end + 4 + size


WARC_ROW = "name string, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, intact boolean, refers_to string, refers_to_id string"


def _warc_row(head: dict, block: bytes) -> tuple:
    stated, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    payload = split_http(block)[1] if kind == "response" else block
    whole = kind != "revisit"
    intact = digest(block) == head["warc-block-digest"].removeprefix("sha1:") and (not whole or digest(payload) == stated)
    return (head["x-source-name"], head["warc-record-id"], kind, head["warc-target-uri"], head["warc-date"], len(payload) if whole else int(head["x-payload-length"]), digest(payload) if whole else stated, intact, head.get("x-refers-to-source-name"), head.get("warc-refers-to"))


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response, resource or revisit of the WARC files in ``folder``. ``intact``: its digests are right."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield _batch([_warc_row(h, b) for h, b in read_warc(content.as_py()) if h["warc-type"] != "warcinfo"], WARC_ROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(parse, WARC_ROW)


def convert(archives: DataFrame, folder: str, order: str = "filename") -> None:
    """ARC archives to WARC files: of records with equal payloads the first by ``order`` stays whole, others revisit it.

    ``order`` is an SQL expression over a record's columns; ties go by path and position, nulls come last.
    Payloads are equal if length and SHA-1 are. Paths must be distinct. Two passes over the archives: one for
    digests (a grouped minimum, combined before the shuffle), one to write. Only revisits are looked up, by
    archive, whose list is as long as its records at most; a payload that a third of all records share is
    never gathered in one place. No archives give no files.
    """
    light = read_archives(archives, payloads=False).select("path", "position", F.coalesce("filename", F.lit("-")).alias("name"), F.expr(order).alias("o"), F.concat_ws(":", "payload_digest", "payload_bytes").alias("_key"))
    light = cut(light)
    place = F.struct(F.col("o").isNull().alias("a"), "o", "path", "position", "name")
    first = light.groupBy("_key").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = hub_join(light, first, "_key", "_n", light.count()).where("path <> _first.path or position <> _first.position")
    again = cut(again.select(F.col("path").alias("_path"), F.struct("position", F.col("_first.path").alias("path"), F.col("_first.position").alias("at"), F.col("_first.name").alias("name")).alias("_one")))
    few = again.limit(REVISITS + 1).count() <= REVISITS
    by_archive = again.groupBy("_path").agg(F.collect_list("_one").alias("again"))
    write_warc(archives.select("path", "content").join(F.broadcast(by_archive) if few else by_archive, F.col("path") == F.col("_path"), "left"), folder)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC (version 2), ARC to WARC, WARC to rows. A page with a null id keeps a null id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    convert(pages_to_arc(pages), folder, "try_cast(filename as bigint)")
    rows = read_warcs(spark, folder)
    return rows.select(
        F.expr("try_cast(name as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
        "record_id",
        "url",
        "date",
        "intact",
    )
