"""Web archives packed as ZIP files: writing them, and reading records by ranges.

A package is a ZIP file with stored (uncompressed) members archive/data.warc.gz,
in which each record is a gzip member of its own, and indexes/index.cdxj, one line
for each record: key, timestamp, and JSON with its offset and length in the archive
member.

The reader never extracts: it parses the end record, the ZIP64 end record where
there is one, the central directory with ZIP64 extra fields and the local headers,
and then reads index lines and single records with range reads. It takes packages of
other writers: plain or gzip-compressed indexes (.cdxj, .cdx), numbers as strings,
several archive members, records that aren't compressed, HTTP responses. What is
damaged becomes a row that isn't valid.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs

_END, _END64, _LOC64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ARCHIVE, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_BIG = 0xFFFFFFFF


class Member(NamedTuple):
    """A file in a package; offset is that of its local header."""

    name: str
    method: int
    offset: int
    stored: int
    size: int
    crc: int


def central_directory(f, size: int) -> list[Member]:
    """Members of a ZIP or ZIP64 file; f has read_at(n, offset)."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or length == _BIG or begin == _BIG:
        if at >= 20 and tail[at - 20 : at - 16] == _LOC64:
            end64 = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
            record = f.read_at(56, end64)
            if record[:4] != _END64:
                raise ValueError("damaged ZIP file: no ZIP64 end record")
            count, length, begin = struct.unpack("<QQQ", record[32:56])
    raw, members, at = f.read_at(length, begin), [], 0
    for _ in range(count):
        if raw[at : at + 4] != _CENTRAL:
            raise ValueError("damaged ZIP file: central directory")
        method, _, _, crc, stored, full, n_name, n_extra, n_comment = struct.unpack("<HHHIIIHHH", raw[at + 10 : at + 34])
        offset = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:
                values = [struct.unpack("<Q", extra[e + 4 + 8 * i : e + 12 + 8 * i])[0] for i in range(n // 8)]
                if full == _BIG and values:
                    full = values.pop(0)
                if stored == _BIG and values:
                    stored = values.pop(0)
                if offset == _BIG and values:
                    offset = values.pop(0)
            e += 4 + n
        members.append(Member(name, method, offset, stored, full, crc))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_offset(f, member: Member) -> int:
    """Where a member's data begins, from its local header."""
    head = f.read_at(30, member.offset)
    if head[:4] != _LOCAL:
        raise ValueError("damaged ZIP file: local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member.offset + 30 + n_name + n_extra


class Package:
    """Writes one package to a stream. zip64: use ZIP64 records whatever the sizes."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, pieces: list[bytes]) -> None:
        raw, size, crc = name.encode(), sum(map(len, pieces)), 0
        for piece in pieces:
            crc = zlib.crc32(piece, crc)
        big = self.zip64 or size >= _BIG or self.at >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = _BIG if big else size
        self.members.append((raw, crc, size, self.at, big))
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        for piece in pieces:
            self._put(piece)

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, offset, big in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            short = _BIG if big else size
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, _BIG if big else offset) + raw + extra)
        end, n = self.at, len(self.members)
        if self.zip64 or end >= _BIG:
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, end - begin, begin) + _LOC64 + struct.pack("<IQI", 0, end, 1))
            self._put(_END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, _BIG, _BIG, 0))
        else:
            self._put(_END + struct.pack("<HHHHIIH", 0, 0, n, n, end - begin, begin, 0))


def warc_record(url: str, record_id: int, body: bytes) -> bytes:
    """A WARC/1.1 resource record as a gzip member."""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{record_id}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + body + b"\r\n\r\n") + gz.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record, plain or a gzip member.

    The payload of an HTTP response is what follows its headers.
    """
    if raw[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        data = stream.decompress(raw) + stream.flush()
        if not stream.eof:
            raise ValueError("a gzip member is cut short")
    else:
        data = raw
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields.get("content-length", -1))
    if not 0 <= size <= len(rest):
        raise ValueError("a WARC record is cut short")
    body = rest[:size]
    if fields.get("warc-type") == "response" and body[:5] == b"HTTP/":
        body = body.partition(b"\r\n\r\n")[2]
    return fields, body


def _same_digest(body: bytes, want: str | None) -> bool:
    """Whether an index's digest (algorithm:value, hexadecimal or base 32) is the payload's; true for none and for unknown algorithms."""
    kind, _, value = (want or "").rpartition(":")
    kind = kind.lower().replace("-", "") or ("sha1" if len(value) == 32 else "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(kind, body).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _write(root: str, package_bytes: int):
    def run(batches):
        where, base = fs.FileSystem.from_uri(root)
        where.create_dir(base, recursive=True)
        records: list[bytes] = []
        lines: list[bytes] = []
        size = 0

        def close():
            name = hashlib.sha256(b"".join(lines)).hexdigest()[:32] + ".wacz"  # what a repeated task would write again
            part = f"{base}/{name}.{uuid.uuid4().hex}.part"
            with where.open_output_stream(part) as out:
                package = Package(out)
                package.add("datapackage.json", [json.dumps({"profile": "data-package", "records": len(lines)}).encode()])
                package.add(_ARCHIVE, records)
                package.add(_INDEX, lines)
                package.close()
                total = package.at
            where.move(part, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64())], ["package", "n_bytes"])

        for batch in batches:
            for id_, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                raw = warc_record(url, id_, body)
                lines.append(f"{url.replace(' ', '%20')} 20240101000000 ".encode() + json.dumps({"url": url, "offset": str(size), "length": str(len(raw)), "filename": _ARCHIVE[8:], "digest": "sha256:" + hashlib.sha256(body).hexdigest()}).encode() + b"\n")
                records.append(raw)
                size += len(raw)
                if size >= package_bytes:
                    yield close()
                    records, lines, size = [], [], 0
        if records:
            yield close()

    return run


def write_packages(pages: DataFrame, root: str, package_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes pages to packages under `root`, a folder all executors share: (package, n_bytes).

    Rows with NULL id, url or body are left out; line breaks in a url become
    blanks. Packages of a task that is run again have the same names.
    """
    base = jobs.picked(pages, id=id_col, url=url_col, body=body_col).where("id is not null and url is not null and body is not null")
    base = base.select(F.col("id").cast("long").alias("id"), F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), F.col("body").cast("binary").alias("body"))
    return jobs.saved(base.mapInArrow(_write(root, package_bytes), "package string, n_bytes long"), "packages")


_LISTED = "package string, url string, offset long, length long, digest string, error string"


def _index_lines(f, member: Member) -> list[bytes]:
    """Lines of an index member, which may be deflated in the package, compressed by itself, or both."""
    raw = f.read_at(member.stored, data_offset(f, member))
    if member.method == 8:
        raw = zlib.decompress(raw, -15)
    if zlib.crc32(raw) != member.crc:
        raise ValueError(f"{member.name} is damaged")
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)  # all members
    return raw.splitlines()


def _package_records(f, package: str) -> list[tuple]:
    """Rows of _LISTED for one package."""
    members = {m.name: m for m in central_directory(f, f.size())}
    archives = {name: data_offset(f, m) for name, m in members.items() if name.startswith("archive/") and m.size}
    rows, covered = [], set()
    for name, m in sorted(members.items()):
        if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            continue
        for line in _index_lines(f, m):
            if b"{" not in line:
                continue  # a header
            try:
                x = json.loads(line[line.index(b"{") :])
                own, url = "archive/" + x["filename"].removeprefix("archive/") if x.get("filename") else _ARCHIVE, x.get("url")
                offset, length = int(x["offset"]), int(x["length"])
                if own not in archives:
                    raise ValueError(f"no member {own}")
                if offset < 0 or length < 0 or offset + length > members[own].stored:
                    raise ValueError(f"a range beyond {own}")
                covered.add(own)
                if members[own].method:
                    raise ValueError(f"{own} isn't stored, so it can't be read by ranges")
                rows.append((package, url, archives[own] + offset, length, x.get("digest"), None))
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                rows.append((package, None, None, None, None, f"index line: {e}"))
    for name in archives:
        if name not in covered:
            raise ValueError(f"no index line names {name}, so its records can't be found")
    return rows


def _list_records(root: str):
    def run(batches):
        where, base = fs.FileSystem.from_uri(root)
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for package in batch.column(0).to_pylist():
                try:
                    with where.open_input_file(f"{base}/{package}") as f:
                        rows = _package_records(f, package)
                except (ValueError, struct.error, zlib.error, EOFError) as e:
                    rows = [(package, None, None, None, None, str(e))]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["package", "url", "offset", "length", "digest", "error"])

    return run


def _read_records(root: str):
    def run(batches):
        where, base = fs.FileSystem.from_uri(root)
        names = ["record_id", "url", "package", "n_bytes", "digest", "valid", "body", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
        name, f = None, None
        for batch in batches:
            rows = []
            for package, url, offset, length, digest, error in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if error is None:
                    if package != name:
                        if f is not None:
                            f.close()
                        name, f = package, where.open_input_file(f"{base}/{package}")
                    try:
                        fields, body = parse_record(f.read_at(length, offset))
                        own = hashlib.sha256(body).hexdigest()
                        at = fields.get("warc-target-uri")
                        wrong = "digest" if not _same_digest(body, digest) else "url" if url is not None and at != url else None
                        rows.append((fields.get("warc-record-id", "").strip("<>"), at, package, len(body), own, wrong is None, body, wrong and f"the index has another {wrong}"))
                        continue
                    except (ValueError, zlib.error) as e:
                        error = str(e)
                rows.append((None, url, package, None, None, False, None, error))
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        if f is not None:
            f.close()

    return run


def read_packages(packages: DataFrame, root: str) -> DataFrame:
    """All records of the packages (column `package`: names under `root`).

    Returns record_id (of the record's header), url, package, n_bytes, digest
    (SHA-256 of the payload), valid (the payload has the index's digest and url),
    body and error. The index lines are spread over all tasks before records are
    read, so one large package doesn't keep one task busy.

    A record or index line that can't be read is a row that isn't valid, with what
    is known of it and the error; so is a package that isn't a ZIP file, or has an
    archive member that no index line names. Missing packages fail.
    """
    listed = packages.select("package").distinct().mapInArrow(_list_records(root), _LISTED)
    spread = listed.repartition("package", (F.col("offset") / F.lit(4 << 20)).cast("long")).sortWithinPartitions("package", "offset")
    return spread.mapInArrow(_read_records(root), "record_id string, url string, package string, n_bytes long, digest string, valid boolean, body binary, error string")
