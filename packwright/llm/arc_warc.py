"""Legacy ARC archives and their conversion to WARC.

An ARC file opens with a version block that names the fields of its header lines: version 1 has
URL, address, date, type and length; version 2 adds result code, checksum, location, offset and file
name.  The converter reads each header line by those fields, takes the declared number of bytes as
the record, and synthesises the WARC record: a deterministic identifier, the date in ISO form, the
record type from the URL scheme, payload and block digests.  Of equal payloads of at least
``revisit_from`` bytes, the record with the smallest page id is the response, the others revisit it.

Only digests, ids and positions are shuffled, never payloads: each archive is read, converted and
written by one task, as a stream, and archives are bounded by ``roll_bytes``.

Defined cases: a null html is an empty payload; a null or blank URL becomes ``urn:page:<id>``; white
space in a URL is percent-encoded; rows with a null page_id are always responses; repeated rows of
the smallest page_id are responses with the same identifier; an empty table makes no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import filesystem, new_folder, stored, write_whole
from .textscan import map_columns

#: Fixed values of the public formats: the field names of ARC header lines and the WARC revisit profile.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")


@dataclass(frozen=True)
class Archives:
    """date: of records whose table has none; roll_bytes: raw size at which an archive is closed."""

    date: str = "20240101000000"
    address: str = "0.0.0.0"
    roll_bytes: int = 32 << 20
    revisit_from: int = 100


def split_head(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and the rest; lines may end with CRLF or, as legacy servers have it, LF."""
    blank = re.search(rb"\r?\n\r?\n", block)
    end = blank.end() if blank else len(block)
    return block[:end], block[end:]


@dataclass(frozen=True)
class ArcRecord:
    number: int
    url: str
    address: str
    date: str
    mime: str
    body: bytes

    @property
    def is_http(self) -> bool:
        return self.body.startswith(b"HTTP/")

    def split(self) -> tuple[bytes, bytes]:
        """HTTP head with its blank line, and payload; other records are payload alone."""
        return split_head(self.body) if self.is_http else (b"", self.body)

    @property
    def page_id(self) -> int | None:
        found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", self.split()[0])
        return int(found[1]) if found else None


def gzip_member(data: bytes, level: int = 1) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def arc_head(name: str, version: int, options: Archives) -> bytes:
    block = f"{version} 0 packwright\n{ARC_FIELDS[version]}\n\n".encode()
    fields = f"filedesc://{name} {options.address} {options.date} text/plain"
    return f"{fields}{' 200 - - 0 ' + name if version == 2 else ''} {len(block)}\n".encode() + block


def arc_entry(page_id: int | None, url: str | None, html: str | None, version: int, offset: int, name: str, options: Archives) -> bytes:
    payload = (html or "").encode(errors="replace")
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or f"urn:page:{page_id}"
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    more = f" 200 {zlib.crc32(body):08x} - {offset} {name}" if version == 2 else ""
    return f"\n{url} {options.address} {options.date} text/html{more} {len(body)}\n".encode(errors="replace") + body


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC stream of either version, the version block first as number 0."""
    line, number, fields = stream.readline(), 0, []
    while line:
        if line.strip():
            line = line.rstrip(b"\r\n").decode(errors="replace")
            length = int(line.rpartition(" ")[2])
            body = stream.read(length)
            if len(body) != length:
                raise ValueError(f"record {number} ends after {len(body)} of {length} bytes")
            if number == 0:
                fields = body.decode(errors="replace").split("\n")[1].split(" ")
            values = dict(zip(fields, line.rsplit(" ", len(fields) - 1)))  # a URL may hold spaces
            if len(values) != len(fields):
                raise ValueError(f"record {number} lacks fields: {line[:200]}")
            yield ArcRecord(number, values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], body)
            number += 1
        line = stream.readline()


def open_archive(uri: str):
    """Stream of an archive's bytes, gzip members or plain."""
    system, path = filesystem(uri)
    raw = system.open_input_stream(path, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url if page_id is None else ""} {digest}')}>"


def warc_date(date: str) -> str:
    """ISO form of an ARC date; what a short date lacks is the start of its year, month, day, hour or minute."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00010101000000"[len(digits) :]
    month, day = (max("01", part) for part in (digits[4:6], digits[6:8]))
    return f"{digits[:4]}-{month}-{day}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_record(record: ArcRecord, refers_to: tuple[int, str] | None = None) -> bytes:
    """The WARC record of an ARC record; refers_to: page id and URL of the response that it repeats."""
    head, payload = record.split()
    digest = hashlib.sha256(payload).hexdigest()
    kind = "warcinfo" if record.number == 0 else "revisit" if refers_to else "response" if record.is_http else "resource"
    block = head if refers_to else record.body
    mime = {"warcinfo": "application/warc-fields", "resource": record.mime}.get(kind, "application/http; msgtype=response")
    if kind == "warcinfo":
        block = f"software: packwright arc converter\r\nformat: WARC File Format 1.1\r\nisPartOf: {record.url.removeprefix('filedesc://')}\r\n".encode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(record.page_id, record.url, digest), "WARC-Date": warc_date(record.date)}
    if kind != "warcinfo":
        fields |= {"WARC-Target-URI": record.url, "WARC-IP-Address": record.address, "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Payload-Bytes": str(len(payload))}
    fields["WARC-Block-Digest"] = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    if refers_to:
        page, url = refers_to
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(page, url, digest), "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Page-Id": str(page)}
    fields |= {"Content-Type": mime, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode(errors="replace") + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            fields[name] = value.strip()
        yield fields, stream.read(int(fields["Content-Length"]))


def write_arcs(pages: DataFrame, folder: str, options: Archives = Archives()) -> DataFrame:
    """Writes pages(page_id, url, html) as ARC archives, versions 1 and 2 by turns; rows: path, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rolled = TaskContext.get().partitionId(), 0
        version = 1 + part % 2
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        row = next(rows, None)
        while row is not None:
            name, n = f"part-{part:06d}-{rolled:04d}.arc.gz", 0

            def members() -> Iterator[bytes]:
                nonlocal row, n
                size = len(data := arc_head(name, version, options))
                yield gzip_member(data)
                while row is not None and size < options.roll_bytes:
                    data = arc_entry(*row, version, size, name, options)
                    size, n, row = size + len(data), n + 1, next(rows, None)
                    yield gzip_member(data)

            write_whole(f"{folder}/{name}", members())
            rolled += 1
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [n]})

    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stored(map_columns(typed, ["page_id", "url", "html"], run, "path string, n long"), "arc-manifest")


def scan_arcs(archives: DataFrame, files: int) -> DataFrame:
    """path, number, page_id, url, digest, size of each record of the archives at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for record in read_arc(open_archive(path)):
                    if record.number:
                        payload = record.split()[1]
                        rows.append((path, record.number, record.page_id, record.url, hashlib.sha256(payload).hexdigest(), len(payload)))
                if rows:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "number", "page_id", "url", "digest", "size"])

    return archives.select("path").repartition(files).mapInArrow(run, "path string, number long, page_id long, url string, digest string, size long")


def convert_arcs(archives: DataFrame, folder: str, options: Archives = Archives()) -> DataFrame:
    """Converts ARC archives (path) of any origin to WARC archives; rows: path, n."""
    files = max(1, archives.count())
    scanned = stored(scan_arcs(archives, files), "arc-scan")
    long = scanned.where((F.col("size") >= options.revisit_from) & F.col("page_id").isNotNull())
    # digests that occur once need no join; both sides of the join are then plain tables, which AQE can split
    shared = long.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("to_page")).where("n > 1").select("digest", "to_page")
    shared = stored(shared, "arc-shared")
    firsts = long.select("digest", F.col("page_id").alias("to_page"), F.col("url").alias("to_url")).join(shared, ["digest", "to_page"]).groupBy("digest", "to_page").agg(F.min("to_url").alias("to_url"))
    firsts = stored(firsts, "arc-firsts")
    again = long.join(firsts, "digest").where("page_id <> to_page").select("path", "number", "to_page", "to_url")
    work = archives.select("path", F.lit(0).cast("long").alias("number"), F.lit(None).cast("long").alias("to_page"), F.lit(None).cast("string").alias("to_url")).unionByName(again)

    def convert(rows: pd.DataFrame) -> pd.DataFrame:
        path = rows["path"].iloc[0]
        refers = {n: (int(p), u) for n, p, u in zip(rows["number"], rows["to_page"], rows["to_url"]) if n}
        name, n = re.sub(r"\.arc(\.gz)?$", "", path.rpartition("/")[2]), 0

        def members() -> Iterator[bytes]:
            nonlocal n
            for record in read_arc(open_archive(path)):
                n += record.number > 0
                yield gzip_member(warc_record(record, refers.get(record.number)))

        target = f"{folder}/{name}-{hashlib.sha1(path.encode()).hexdigest()[:8]}.warc.gz"
        write_whole(target, members())
        return pd.DataFrame({"path": [target], "n": [n]})

    # a fixed number of partitions: the rows are tiny, but each stands for an archive to convert
    return stored(work.repartition(files, "path").groupBy("path").applyInPandas(convert, "path string, n long"), "warc-manifest")


def read_warcs(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records in WARC archives (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for fields, block in read_warc(open_archive(path)):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_head(block)
                    number = lambda name: int(m[1]) if (m := re.search(rb"(?mi)^" + name + rb": (-?\d+)\r?$", head)) else None
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Bytes"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {path}")
                    refers = fields.get("WARC-Refers-To-Page-Id")
                    rows.append((number(b"X-Page-Id"), size, digest, kind, refers and int(refers)))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, options: Archives = Archives()) -> DataFrame:
    """Pages to ARC archives, those to WARC archives, and the records read back from the WARC archives."""
    folder = new_folder(pages.sparkSession, "archives")
    return read_warcs(convert_arcs(write_arcs(pages, f"{folder}/arc", options), f"{folder}/warc", options))
