"""Legacy ARC archives and their conversion to WARC.

`read_arc` parses the header lines of ARC versions 1 and 2 by their declared lengths. `convert` synthesises for each record the
WARC identifier, timestamp, type and digests. `archive_pages` writes archives of a table in a shared folder and `read_archives`
reads such archives back.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import salted_left, shared_path, small_batches, stored

#: The fields of a URL record's header line, by ARC version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: An archive file is closed beyond this many bytes before compression.
FILE_BYTES = 32 << 20


# --- ARC -----------------------------------------------------------------------------------------------------------------------


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block with which an ARC file begins."""
    body = f"{version} 0 quillframe\n{' '.join(TITLES[f] for f in FIELDS[version])}\n\n".encode()
    line = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "mime": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + body


def spelled(url: str | None) -> str:
    """The URL as a header line can hold it."""
    return quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._") or "-"


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, ip: str = "0.0.0.0", result: int = 200, offset: int = 0, name: str = "-") -> bytes:
    line = {"url": spelled(url), "ip": ip, "date": date, "mime": mime, "result": str(result), "checksum": "-", "location": "-", "offset": str(offset), "filename": name, "length": str(len(block))}
    return b"\n" + " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + block


class ArchiveError(ValueError):
    """An archive that breaks its format."""


def read_arc(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record, the version block first. Lines are parsed from the right, as URLs may hold spaces.

    The version is what the version block says; before it is known, a header line's number of fields decides.
    """
    version = None
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        fields = FIELDS[version or (2 if len(parts) >= len(FIELDS[2]) else 1)]
        if len(parts) < len(fields):
            raise ArchiveError(f"header line with {len(parts)} fields instead of {len(fields)}")
        tail = parts[len(parts) - len(fields) + 1 :]
        head = dict(zip(fields, [" ".join(parts[: len(parts) - len(fields) + 1]), *tail], strict=True))
        if not head["length"].isdigit():
            raise ArchiveError(f"declared length {head['length']!r}")
        block = stream.read(int(head["length"]))
        if len(block) != int(head["length"]):
            raise ArchiveError(f"record ends after {len(block)} of {head['length']} bytes")
        if version is None:
            if not head["url"].startswith("filedesc://"):
                raise ArchiveError("no version block")
            number = block.split(b" ", 1)[0]
            if number not in (b"1", b"2"):
                raise ArchiveError(f"version {number!r}")
            version = int(number)
        yield head, block


# --- conversion ----------------------------------------------------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and payload."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = block.find(gap)
        if at >= 0:
            return block[: at + len(gap)], block[at + len(gap) :]
    return block, b""


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


def iso_date(date: str) -> str:
    """WARC's timestamp of a 14-digit date; missing digits are those of the least date."""
    d = (date if date.isdigit() else "")[:14]
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {key}')}>"


def convert(records: Iterable[tuple[dict, bytes]], original=lambda head: None) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """WARC headers and block of each ARC record.

    The version block becomes warcinfo, an HTTP reply response, anything else resource. original(http header) may name the record
    that a reply with the same payload repeats, as (target URI, key, date, extra headers): the reply is then a revisit, which keeps
    its HTTP header and leaves out the payload.
    """
    for head, block in records:
        url, date = head["url"], iso_date(head["date"])
        if url.startswith("filedesc://"):
            info = f"software: quillframe\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {block.split(b' ', 1)[0].decode()}\r\n".encode()
            yield [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(url, date, "info")), ("WARC-Date", date), ("WARC-Filename", url[11:]), ("Content-Type", "application/warc-fields")], info
            continue
        http = block.startswith(b"HTTP/")
        top, payload = split_http(block) if http else (b"", block)
        digest = hashlib.sha256(payload).hexdigest()
        key = header_value(top, "X-Page-Id") or digest
        first = original(top) if http else None
        headers = [("WARC-Type", "revisit" if first else "response" if http else "resource"), ("WARC-Record-ID", record_id(url, date, key)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", head["ip"]), ("WARC-Payload-Digest", f"sha256:{digest}")]
        if first:
            uri, first_key, first_date, extra = first
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(uri, first_date, first_key)), ("WARC-Truncated", "length"), *extra]
            block = top
        headers += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response" if http else head["mime"])]
        yield headers, block


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a plain or gzipped WARC stream; one record is in memory at a time."""
    stream = Members(stream)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"record begins with {line[:20]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ArchiveError(f"record ends after {len(block)} of {n} bytes")
        yield head, block


class Members:
    """readline and read over the concatenated gzip members of a stream, or over a plain stream."""

    def __init__(self, raw):
        self.raw, self.buffer, self.at, self.inflate, self.rest = raw, b"", 0, None, raw.read(1 << 16)
        self.plain = not self.rest.startswith(b"\x1f\x8b")

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.raw.read(1 << 16)
                if not self.rest:
                    return False
            if self.plain:
                new, self.rest = self.rest, b""
            else:
                if self.inflate is None or self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                new = self.inflate.decompress(self.rest)
                self.rest = self.inflate.unused_data
            if new:
                self.buffer, self.at = self.buffer[self.at :] + new, 0
                return True

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buffer) - 1
                break
        out, self.at = self.buffer[self.at : end + 1], end + 1
        return out

    def read(self, n: int) -> bytes:
        parts, have = [], 0
        while True:
            part = self.buffer[self.at : self.at + n - have]
            self.at += len(part)
            have += len(part)
            parts.append(part)
            if have == n or not self._more():
                return b"".join(parts)


# --- tables --------------------------------------------------------------------------------------------------------------------

DATE = "20240101000000"


def _page_block(page_id, payload: bytes, extra: str = "") -> bytes:
    ident = "" if page_id is None or page_id != page_id else f"X-Page-Id: {int(page_id)}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}{extra}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _original(top: bytes):
    ref = header_value(top, "X-Same-As")
    if ref is None:
        return None
    uri = header_value(top, "X-Same-As-URI") or "-"
    return uri, ref, iso_date(DATE), [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", iso_date(DATE)), ("X-Refers-To-Page", ref)]


def _write(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        done, out, size, records = [], None, 0, 0
        name = temporary = ""

        def close():
            nonlocal out
            if out is not None:
                out.close()
                fs.move(temporary, f"{base}/{name}")  # a retried or speculative task replaces the file by an equal one
                done.append((f"{root}/{name}", records))
            out = None

        for batch in batches:
            for row in batch.itertuples(index=False):
                version = 1 + (hash_of(row.url) & 1)
                payload = (row.html or "").encode("utf-8", "surrogatepass")
                same = "" if pd.isna(row.first_page) else f"X-Same-As: {int(row.first_page)}\r\nX-Same-As-URI: {spelled(row.first_url)}\r\n"
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(done):05d}.warc.gz"
                    temporary, size, records = f"{base}/.{name}.{task.taskAttemptId()}", 0, 0
                    out = fs.open_output_stream(temporary, compression=None)
                legacy = arc_header(version, name.replace("warc", "arc"), DATE) + arc_record(version, row.url or "", DATE, "text/html", _page_block(row.page_id, payload, same), name="-")
                for k, (headers, block) in enumerate(convert(read_arc(io.BytesIO(legacy)), _original)):
                    if k or not records:  # one warcinfo in a file
                        data = warc_record(headers, block)
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        out.write(packer.compress(data) + packer.flush())
                        size += len(data)
                        records += 1
                if size >= FILE_BYTES:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "records"])

    return run


def hash_of(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes one WARC record per row of `pages` (page_id, url, html) in the shared folder. Returns the archives: path, records.

    Each row is framed as a record of an ARC file, of version 1 or 2 by its URL, and goes through the converter. Of rows with equal
    payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is a response and the others revisit it; smaller
    ones are all responses. Null html is an empty payload, null url the URI "-". Rows with a null page_id come after all others of
    their payload; where only such rows share a payload, or rows repeat a page_id, all of them are responses. An empty table gives
    no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html").withColumns({"_digest": F.sha2(F.coalesce("html", F.lit("")), 256), "_big": F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_REVISIT})
    groups = rows.filter("_big").groupBy("_digest").agg(F.min("page_id").alias("first_page"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_f"), F.count("*").alias("_n"))
    groups = groups.filter("_n > 1 and first_page is not null").select("_digest", "first_page", F.col("_f.url").alias("first_url"))
    rows = salted_left(rows, groups, "_digest", by=F.xxhash64("page_id", "url"))
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    rows = rows.select("page_id", "url", "html", F.when(again, F.col("first_page")).alias("first_page"), F.when(again, F.col("first_url")).alias("first_url"))
    small_batches(spark)
    root = shared_path(spark, "warc")
    return stored(rows.mapInPandas(_write(root), "path string, records long"), "warc-list")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            fs, at = pafs.FileSystem.from_uri(path)
            found = []
            with fs.open_input_stream(at, compression=None) as raw:
                for head, block in read_warc(raw):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    top, payload = split_http(block)
                    declared = head["warc-payload-digest"].removeprefix("sha256:")
                    size = int(header_value(top, "Content-Length"))
                    if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != declared or len(payload) != size):
                        raise ArchiveError(f"payload of {head['warc-record-id']} doesn't match its digest or length")
                    page, ref = header_value(top, "X-Page-Id"), head.get("x-refers-to-page")
                    found.append((None if page is None else int(page), size, declared, head["warc-type"], None if ref is None else int(ref), head["warc-target-uri"], head["warc-record-id"]))
                    if len(found) >= 5000:
                        yield _frame(found)
                        found = []
            yield _frame(found)


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(archives: DataFrame) -> DataFrame:
    """Responses and revisits of the archives whose paths are in column path; payload digests of responses are verified."""
    n = archives.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return archives.select("path").repartition(int(n), "path").mapInPandas(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string")

