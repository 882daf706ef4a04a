"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

A text is split into pieces by the tokenizer's pattern (contractions; letters,
digits or other signs with at most one space before them; white space). For each
distinct piece of a chunk, the ids of its parts and the ranks of adjacent parts
lie in contiguous arrays: the least rank is found by a scan, the boundary there is
deleted, and the ranks left and right of it are looked up again, until no pair
has a rank. All pieces of one length are rows of one matrix and take each step
together. Pieces of more than 48 bytes keep a heap of ranks instead of scanning.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import jobs, texts

U64 = np.uint64
_NONE = np.int32(2**31 - 1)
_LONG = 48
_LETTER, _DIGIT, _SPACE = 1, 2, 3
_CHUNK = 1 << 20


def _char_classes() -> np.ndarray:
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for name, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _DIGIT), (r"\s+", _SPACE)):
        for m in regex.finditer(name, text):
            a, b = m.span()
            out[ord(text[a]) : ord(text[b - 1]) + 1] = value
    out[0xD800:0xE000] = 0
    return out


class Vocabulary:
    """Tokens by id, and the rank of each mergeable pair in a hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = size
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), U64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        self.keys = np.full(1 << self.bits, U64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, _NONE)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == U64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.pairs = pairs
        self.classes = _char_classes()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE if they don't merge."""
        keys = (a.astype(U64) << U64(32)) | b.astype(U64)
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((got != keys) & (got != U64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (got != U64(0xFFFFFFFFFFFFFFFF))]
        return out


_loaded: dict[int, Vocabulary] = {}


def parse(raw: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines: token in base64, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def _vocabulary(raw: bytes) -> Vocabulary:
    key = hash(raw)
    if key not in _loaded:
        _loaded[key] = Vocabulary(parse(raw))
    return _loaded[key]


def split(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces start; pieces fill the texts, none crosses a border."""
    if not len(buf):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
    code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = classes[code]
    begin = np.zeros(n + 1, bool)
    begin[np.searchsorted(at, off)] = True
    begin = begin[:n]
    change = begin.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    is_space = kind == _SPACE
    # the last white space of a run before something else: a token of its own, or joined to what follows if it's a blank
    ends = np.zeros(n, bool)
    ends[:-1] = is_space[:-1] & change[1:] & ~begin[1:]
    start |= ends
    joined = np.zeros(n, bool)
    joined[1:] = ends[:-1] & (code[:-1] == 32)
    start &= ~joined
    # contractions, where a sign starts a match
    quote = np.flatnonzero((code == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~begin[quote + 1]]
    a = code[quote + 1]
    b = np.where(quote + 2 < n, code[np.minimum(quote + 2, n - 1)], 0)
    b = np.where((quote + 2 < n) & ~begin[np.minimum(quote + 2, n - 1)], b, 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    start[quote[one | two] + 1] = False
    after = np.concatenate([quote[one] + 2, quote[two] + 3])
    start[after[after < n]] = True
    return at[start]


def _encode_long(piece: bytes, vocab: Vocabulary) -> list[int]:
    """One long piece, with a heap of (rank, position) over linked parts."""
    ids: list[int] = vocab.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    nxt, prv, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), vocab.pairs
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
            continue
        ids[i] = rank
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            r = pairs.get(rank << 32 | ids[nxt[i]])
            if r is not None:
                heapq.heappush(heap, (r, i))
        if prv[i] >= 0:
            r = pairs.get(ids[prv[i]] << 32 | rank)
            if r is not None:
                heapq.heappush(heap, (r, prv[i]))
    return [x for x, a in zip(ids, alive) if a]


def encode_pieces(buf: np.ndarray, start: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and how many each has."""
    count = np.zeros(len(start), np.int64)
    found_row, found_at, found_id = [], [], []
    order = np.argsort(size, kind="stable")
    sizes, first = np.unique(size[order], return_index=True)
    edges = np.append(first, len(order))
    for length, lo, hi in zip(sizes.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
        if length > _LONG:
            for r in order[lo:hi].tolist():
                ids = _encode_long(buf[start[r] : start[r] + length].tobytes(), vocab)
                count[r] = len(ids)
                found_row.append(np.full(len(ids), r))
                found_at.append(np.arange(len(ids)))
                found_id.append(np.array(ids, np.int32))
            continue
        rows = order[lo:hi]
        ids = vocab.byte_id[buf[start[rows][:, None] + np.arange(length)[None, :]]]
        rank = vocab.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), length - 1)
        width = length
        while width > 1:
            spot = rank.argmin(1)
            at = np.arange(len(rows))
            least = rank[at, spot]
            done = least == _NONE
            if done.any():
                d = np.flatnonzero(done)
                count[rows[d]] = width
                found_row.append(np.repeat(rows[d], width))
                found_at.append(np.tile(np.arange(width), len(d)))
                found_id.append(ids[d].ravel())
                keep = np.flatnonzero(~done)
                rows, ids, rank, spot, least = rows[keep], ids[keep], rank[keep], spot[keep], least[keep]
                if not len(rows):
                    break
                at = np.arange(len(rows))
            ids[at, spot] = least
            # delete the boundary: parts and ranks right of it move one to the left
            col = np.arange(width - 1)[None, :]
            ids = np.where(col > spot[:, None], ids[:, 1:], ids[:, :-1])
            width -= 1
            if width > 1:
                col = np.arange(width - 1)[None, :]
                rank = np.where(col >= spot[:, None], rank[:, 1:], rank[:, :-1])
                r = np.flatnonzero(spot < width - 1)
                rank[r, spot[r]] = vocab.rank(ids[r, spot[r]], ids[r, spot[r] + 1])
                r = np.flatnonzero(spot > 0)
                rank[r, spot[r] - 1] = vocab.rank(ids[r, spot[r] - 1], ids[r, spot[r]])
        if width == 1 and len(rows):
            count[rows] = 1
            found_row.append(rows)
            found_at.append(np.zeros(len(rows), np.int64))
            found_id.append(ids[:, 0])
    out = np.zeros(int(count.sum()), np.int32)
    if len(out):
        begin = np.cumsum(count) - count
        out[begin[np.concatenate(found_row)] + np.concatenate(found_at)] = np.concatenate(found_id)
    return out, count


def encode_arrays(buf: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and n + 1 offsets by text."""
    start = split(buf, off, vocab.classes)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    end = np.append(start[1:], len(buf))
    h = texts.range_hash(texts._BYTE_CODE[buf], start, end)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    ids, count = encode_pieces(buf, start[one], (end - start)[one], vocab)
    begin = np.cumsum(count) - count
    each = count[which]
    total = np.concatenate(([0], np.cumsum(each)))
    return ids[texts.ranges(begin[which], each)], total[np.searchsorted(start, off)]


def decode_arrays(ids: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """Texts of lists of ids. Bytes that aren't UTF-8 become U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= vocab.size or (vocab.length[ids] == 0).any()):
        raise ValueError("an id isn't in the vocabulary")
    size = vocab.length[ids]
    buf = vocab.bytes[texts.ranges(vocab.offset[ids], size)]
    where = np.concatenate(([0], np.cumsum(size)))[off]
    try:
        buf.tobytes().decode("utf-8")
        cut = where[(where > 0) & (where < len(buf))]
        if ((buf[cut] & 0xC0) == 0x80).any():
            raise UnicodeDecodeError("utf-8", b"", 0, 1, "a text starts within a character")
    except UnicodeDecodeError:
        raw = buf.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(where[:-1].tolist(), where[1:].tolist())], pa.string())
    return texts.string_array(buf, where)


def _encode(raw: bytes, text_at: int):
    def run(batches):
        vocab = _vocabulary(raw)
        for batch in batches:
            for part, buf, off in texts.chunks(batch, batch.schema.names[text_at], _CHUNK):
                ids, where = encode_arrays(buf, off, vocab)
                missing = pa.compute.is_null(part.column(text_at)).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(ids), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(where).astype(np.int32))], [*part.schema.names, "ids", "n"])

    return jobs.tidy(run)


def _decode(raw: bytes, ids_at: int):
    def run(batches):
        vocab = _vocabulary(raw)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(ids_at)
                missing = pa.compute.is_null(lists)
                size = np.where(missing.to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                text = decode_arrays(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size))), vocab)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.compute.if_else(missing, pa.scalar(None, pa.string()), text)], [*part.schema.names, "text"])

    return jobs.tidy(run)


def _plain(docs: DataFrame, new: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    names = docs.columns
    keep = [i for i, c in enumerate(names) if c not in new]
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in keep]), [names[i] for i in keep]


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """All columns and rows, with token_ids and n_tokens, which replace columns of these names.

    ranks_path: a file of lines with a token in base64 and its rank, read by the
    driver; its size is that of the vocabulary. NULL text: NULL ids, 0 tokens;
    empty text: no ids. Strings that look like special tokens are ordinary text.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()
    plain, kept = _plain(docs, ("token_ids", "n_tokens"))
    schema = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n", T.IntegerType())])
    return plain.mapInArrow(_encode(raw, kept.index(text_col)), schema).toDF(*kept, "token_ids", "n_tokens")


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns and rows, with decoded_text, which replaces a column of that name.

    NULL ids: NULL text; no ids: empty text. Ids outside the vocabulary raise
    ValueError; bytes that aren't UTF-8 become U+FFFD.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()
    plain, kept = _plain(docs, ("decoded_text",))
    schema = T.StructType([*plain.schema.fields, T.StructField("text", T.StringType())])
    return plain.mapInArrow(_decode(raw, kept.index(ids_col)), schema).toDF(*kept, "decoded_text")
