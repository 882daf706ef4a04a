"""Media columns: payloads in tar shards, addressed by digest, offset and length.

Payloads leave the table: each distinct payload is stored once, gzip-compressed,
as a member of a tar shard in a folder that all executors share, and rows keep
its SHA-256 digest, shard, offset and stored length. Metadata columns are filled
afterwards from headers: a reader fetches the first bytes of each member in one
range read, inflates just what it needs, and reads on by further ranges only where
the header isn't complete.

Shards are written under a temporary name and then renamed; a task that is run
again writes the same bytes to the same name. Payloads that one row alone has are
stored where they are read; only those of several rows are brought together.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jobs

_SHARD_BYTES = 64 << 20
_CHARSET = re.compile(rb"<meta[^>]*charset=[\"']?([\w-]+)", re.I)
_LANG = re.compile(rb"<html[^>]*\blang=[\"']?([\w-]+)", re.I)
_TITLE = re.compile(rb"<title[^>]*>(.*?)</title", re.I | re.S)
# scripts, styles and comments, whose contents aren't markup, and titles
_OPAQUE = re.compile(rb"<!--(?:-?>|.*?(?:-->|\Z))|<(script|style|title)\b[^>]*>.*?(?:</\1|\Z)", re.I | re.S)
_HEAD_END = re.compile(rb"</head\s*>|<body\b", re.I)
_META = ["media_type", "width", "height", "lang", "charset", "title"]
_META_SCHEMA = "media_type string, width int, height int, lang string, charset string, title string"


def _html_head(data: bytes) -> tuple[bytes, bool]:
    """A page up to the end of its head, without scripts, styles and comments; and whether that end is there."""
    kept, at = [], 0
    for m in _OPAQUE.finditer(data):
        end = _HEAD_END.search(data, at, m.start())
        if end:
            break
        kept.append(data[at : m.start()])
        if m[1] and m[1].lower() == b"title":
            kept.append(m[0])
        at = m.end()
    else:
        end = _HEAD_END.search(data, at)
    kept.append(data[at : end.start()] if end else data[at:])
    return b" ".join(kept), end is not None


def header_fields(head: bytes) -> dict:
    """What the first bytes of a payload say: type, size of an image, and an HTML page's language, charset and title."""
    return _header(head)[0]


def _header(head: bytes) -> tuple[dict, bool]:
    """header_fields, and whether more bytes can't change them."""
    out: dict = dict.fromkeys(_META)
    done = bool(head.strip())
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        out["media_type"] = "image/png"
        out["width"], out["height"] = struct.unpack(">II", head[16:24])
    elif head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        out["media_type"] = "image/gif"
        out["width"], out["height"] = struct.unpack("<HH", head[6:10])
    elif head[:2] == b"\xff\xd8":
        out["media_type"] = "image/jpeg"
        at, done = 2, False
        while at + 9 < len(head):
            if head[at] != 0xFF or head[at + 1] in (0xD9, 0xDA):  # damaged, or the image's data begin without a frame header
                done = True
                break
            if head[at + 1] == 0xFF:  # fill byte
                at += 1
                continue
            if 0xC0 <= head[at + 1] <= 0xCF and head[at + 1] not in (0xC4, 0xC8, 0xCC):
                out["height"], out["width"] = struct.unpack(">HH", head[at + 5 : at + 9])
                done = True
                break
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    elif head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        out["media_type"] = "audio/wav"
    elif head[:4] == b"%PDF":
        out["media_type"] = "application/pdf"
    elif re.match(rb"\s*(<!doctype html|<html)", head, re.I):
        out["media_type"] = "text/html"
        head, done = _html_head(head)
        found = {name: pattern.search(head) for name, pattern in (("charset", _CHARSET), ("lang", _LANG), ("title", _TITLE))}
        out |= {name: m[1].decode("utf-8", "replace").strip() for name, m in found.items() if m}
        # one that ends where the bytes do may go on
        done |= all(m and m.end() < len(head) for m in found.values())
    else:
        out["media_type"] = "text/plain" if head and b"\0" not in head else "application/octet-stream"
    return out, done


def _digests(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(1)], pa.string())], ["digest"])


def _number(digest: str) -> int:
    """63 bits of a digest."""
    return int(digest[:16], 16) >> 1


class _Shards:
    """Writes members to tar shards; a shard is named after its first member and renamed when complete."""

    def __init__(self, root: str):
        self.where, self.base = fs.FileSystem.from_uri(root)
        self.where.create_dir(self.base, recursive=True)
        self.tar = None

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of a new member."""
        if self.tar is not None and self.tar.offset >= _SHARD_BYTES:
            self.close()
        if self.tar is None:
            self.name = f"{digest}.tar"
            self.part = f"{self.base}/{self.name}.{uuid.uuid4().hex}.part"
            self.out = self.where.open_output_stream(self.part)
            self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.USTAR_FORMAT)
        info = tarfile.TarInfo(f"{digest}.gz")
        info.size = len(data)
        offset = self.tar.offset + 512
        self.tar.addfile(info, io.BytesIO(data))
        return self.name, offset, len(data)

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.out.close()
            self.where.move(self.part, f"{self.base}/{self.name}")
            self.tar = None


_NAMES = ["id", "digest", "n_bytes", "shard", "offset", "length", "payload"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
_PLACED = "id long, digest string, n_bytes long, shard string, offset long, length long, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


def _write_single(root: str, shared: np.ndarray):
    """Stores payloads that no other row has; others go on, compressed, to be stored once."""

    def run(batches):
        shards = _Shards(root)
        for batch in batches:
            rows = []
            for id_, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = x.as_py()
                digest = hashlib.sha256(data).hexdigest()
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = gz.compress(data) + gz.flush()
                if jobs.passes(shared, np.array([_number(digest)]))[0]:
                    rows.append((id_, digest, len(data), None, None, None, raw))
                else:
                    rows.append((id_, digest, len(data), *shards.add(digest, raw), None))
            yield _batch(rows)
        shards.close()

    return run


def _write_shared(root: str):
    """Stores each payload of a partition once; rows come sorted by digest."""

    def run(batches):
        shards, known, place = _Shards(root), None, None
        for batch in batches:
            rows = []
            for id_, digest, size, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(6)):
                if digest != known:
                    known, place = digest, shards.add(digest, payload.as_py())
                rows.append((id_, digest, size, *place, None))
            yield _batch(rows)
        shards.close()

    return run


def store(rows: DataFrame, root: str, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Writes the payloads under `root` and returns (id, digest, n_bytes, shard, offset, length).

    `root` is a URI of a folder that all executors share. Text payloads are
    stored as UTF-8. Equal payloads are stored once, and all their rows point
    there. Rows with NULL id or payload are left out; empty payloads are stored
    like others. Repeated rows each get a row. Other columns are ignored.
    """
    base = jobs.picked(rows, id=id_col, payload=payload_col).select(F.col("id").cast("long").alias("id"), F.col("payload").cast("binary").alias("payload")).where("id is not null and payload is not null")
    # only payloads that several rows have are shuffled, and the filter's few others with them
    digests = base.select("id", "payload").mapInArrow(_digests, "digest string").groupBy("digest").count().where("count > 1")
    numbers = jobs.saved(digests.select(F.conv(F.substring("digest", 1, 16), 16, 10).cast("decimal(20,0)").alias("n")).select(F.floor(F.col("n") / 2).cast("long").alias("n")), "media-digests")
    shared = jobs.id_filter(numbers, numbers.count())
    jobs.discard(numbers)
    first = jobs.saved(base.mapInArrow(_write_single(root, shared), _PLACED), "media-single")
    rest = first.where("payload is not null").repartition("digest").sortWithinPartitions("digest", "id").mapInArrow(_write_shared(root), _PLACED)
    rest = jobs.saved(rest, "media-shared")
    return first.where("payload is null").union(rest).drop("payload")


def read_header(read, length: int, head_bytes: int) -> dict:
    """header_fields of a gzip member of `length` bytes; read(n, at) gives n of them from `at` on.

    Reads and inflates twice as much each time until the header is complete or the
    member ends.
    """
    stream, data, at, step = zlib.decompressobj(31), b"", 0, head_bytes
    while True:
        raw = stream.unconsumed_tail
        if not raw and at < length:
            raw = read(min(step, length - at), at)
            at = at + len(raw) if raw else length
        got = stream.decompress(raw, 4 * step)
        data += got
        fields, done = _header(data)
        if done or stream.eof or (at >= length and not stream.unconsumed_tail and len(got) < 4 * step):
            return fields
        step *= 2


def _read_headers(root: str, head_bytes: int):
    def run(batches):
        where, base = fs.FileSystem.from_uri(root)
        name, f = None, None
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f = shard, where.open_input_file(f"{base}/{shard}")
                found.append(read_header(lambda n, at, f=f, offset=offset: f.read_at(n, offset + at), length, head_bytes))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[c] for x in found], pa.int32() if c in ("width", "height") else pa.string()) for c in _META)], [*batch.schema.names, *_META])
        if f is not None:
            f.close()

    return run


def with_headers(index: DataFrame, root: str, head_bytes: int = 2048) -> DataFrame:
    """The index with metadata columns, from the header of each payload.

    The first `head_bytes` stored bytes are read, and further ranges where a page's
    head or an image's frame header goes on beyond them: NULL means that the payload
    doesn't have it. Rows are read in the order of shards and offsets.
    """
    schema = T.StructType([*index.schema.fields, *T._parse_datatype_string(_META_SCHEMA).fields])
    return index.sortWithinPartitions("shard", "offset").mapInArrow(_read_headers(root, head_bytes), schema)


def _read_payloads(root: str):
    def run(batches):
        where, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            data = []
            for shard, offset, length, digest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length", "digest"))):
                with where.open_input_file(f"{base}/{shard}") as f:
                    raw = zlib.decompress(f.read_at(length, offset), 31)
                if hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"payload {digest} is damaged in {shard}")
                data.append(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "payload"])

    return run


def load(index: DataFrame, root: str) -> DataFrame:
    """The index with the payloads, each checked against its digest."""
    return index.mapInArrow(_read_payloads(root), T.StructType([*index.schema.fields, T.StructField("payload", T.BinaryType())]))
