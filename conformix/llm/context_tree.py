"""Code length of documents under a context tree of the corpus.

Context-tree weighting over bytes: each byte is coded as 8 binary decisions, each
of which has a context tree of its own whose contexts are the last 0 to `depth`
bytes. A node with counts (a, b) has the Krichevsky-Trofimov probability

    P_e = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1))

and the weighted probability P_w = P_e / 2 + (product of the children's P_w) / 2;
P_w = P_e at the depth limit. Both depend on counts alone, not on their order. So
the probability of a bit given all the other bits of the corpus is P_w with it over
P_w without it, at the root: a document isn't predicted from itself as a whole, each
of its bytes is predicted from everything but that very occurrence. On the path of
the bit, from the deepest context up, with n of its node's counts, of which n_x are
of its value,

    1 / q = v n / (n_x - 1/2) + (1 - v) / q',   v = P_e / (P_e + product of children)

where q' is what the child on the path gives; at the depth limit v = 1. This is the
exact mixture of all depths, and depends on the byte and its context alone, so it is
computed once for each distinct (depth + 1)-gram of bytes:

1. Documents are spread over parts; a part counts its byte n-grams.
2. Equal n-grams of all parts are brought together by hash, however common they
   are, and their sums go to homes by the two latest bytes of the context, where
   whole subtrees meet. A home works through slices of about `_SLICE` n-grams. A
   table of fixed size, 256 x 255 nodes, holds depths 0 and 1.
3. Homes answer with the code lengths of n-grams, which go back to the parts'
   requests and to the parts, where they are added up by document. Nothing that
   grows is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs, texts

U64 = np.uint64
#: Bytes of context. Seven at most, as an n-gram is held in 64 bits.
DEPTH = 6
_PART_BYTES = 24 << 20
_CHUNK_BYTES = 1 << 19
_SLICE = 200_000
_TABLE = 1 << 14
#: Text for each of the homes that one context of two bytes is spread over.
_SPLIT_BYTES = 64 << 30


def _lgamma_tables() -> tuple[np.ndarray, np.ndarray]:
    half = np.concatenate(([math.lgamma(0.5)], math.lgamma(0.5) + np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))))
    whole = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _TABLE)))))
    return half, whole


_HALF, _WHOLE = _lgamma_tables()


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def at(table, n, shift):
        big = n >= _TABLE
        if not big.any():
            return table[n]
        out = table[np.where(big, 0, n)]
        out[big] = _stirling(n[big] + shift)
        return out

    return at(_HALF, a, 0.5) + at(_HALF, b, 0.5) - at(_WHOLE, a + b, 1.0) - math.log(math.pi)


def _keys(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """For each byte its context, latest byte first, then itself, as 8 (depth + 1) bits.

    Before a document there are `depth` zero bytes.
    """
    n = len(off) - 1
    size = np.diff(off)
    wide = np.zeros(len(buf) + depth * n + depth, U64)
    at = np.arange(len(buf)) + np.repeat(depth * np.arange(1, n + 1), size)
    wide[at] = buf
    key = wide[at]
    for d in range(1, depth + 1):
        key |= wide[at - d] << U64(8 * (depth - d + 1))
    return key


def _pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit keys, or counts: differences of keys, and the bytes of one place together, which compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, U64), dtype=U64)


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def _chunks(off: np.ndarray):
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(off, off[lo] + _CHUNK_BYTES, "right")) - 1, lo + 1), n)
        yield lo, hi
        lo = hi


def _by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted keys by bucket, and the bucket of each place."""
    bucket = (texts.mix(keys) % U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
    return order, bucket[order]


def _part_counts(buf: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a part and their counts."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    found, size = [], 0
    for lo, hi in _chunks(off):
        own = _keys(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], depth)
        if len(own):
            found.append(texts.distinct(own))
            size += len(found[-1][0])
        if size > max(1_000_000, len(keys) // 2):
            keys, counts = _grouped(np.concatenate([keys, *(x[0] for x in found)]), np.concatenate([counts, *(x[1] for x in found)]))
            found, size = [], 0
    if found:
        keys, counts = _grouped(np.concatenate([keys, *(x[0] for x in found)]), np.concatenate([counts, *(x[1] for x in found)]))
    return keys, counts


def _sorted_distinct(keys: np.ndarray) -> np.ndarray:
    """Sorts the array in place."""
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]]


def _part_keys(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """The keys of _part_counts alone, in less memory."""
    keys, found, size = np.zeros(0, U64), [], 0
    for lo, hi in [*_chunks(off), (0, 0)]:
        if hi:
            found.append(_sorted_distinct(_keys(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], depth)))
            size += len(found[-1])
        if size > max(500_000, len(keys) // 2) or not hi:
            found.append(keys)
            keys = np.concatenate(found)
            found, size = [], 0
            keys = _sorted_distinct(keys)
    return keys


def _edges(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(x):
        return []
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))).tolist()
    return list(zip(at[:-1], at[1:]))


def _table(columns: list, names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _count_part(depth: int, n_buckets: int):
    def run(key, table):
        keys, counts = _part_counts(*texts.text_buffer(table.column("text")), depth)
        order, bucket = _by_bucket(keys, n_buckets)
        keys, counts = keys[order], counts[order]
        rows = [(key[0].as_py(), int(bucket[a]), _pack_keys(keys[a:b]), _pack(counts[a:b].astype(np.uint32))) for a, b in _edges(bucket)]
        return _table(list(zip(*rows)) or [[]] * 4, ["part", "bucket", "grams", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return jobs.tidy_group(run)


def _combine(depth: int, n_homes: int, split: int):
    """Sums of a bucket over all parts, by home: that of the two latest bytes of the context, and of the third modulo split."""

    def run(key, table):
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        found, size = [], 0
        rows = list(zip(table.column("grams"), table.column("counts")))
        for i, (g, c) in enumerate(rows):
            found.append((_unpack_keys(g.as_py()), _unpack(c.as_py(), np.uint32).astype(np.int64)))
            size += len(found[-1][0])
            if size > max(1_000_000, len(keys)) or i == len(rows) - 1:
                keys, counts = _grouped(np.concatenate([keys, *(x[0] for x in found)]), np.concatenate([counts, *(x[1] for x in found)]))
                found, size = [], 0
        third = ((keys >> U64(8 * (depth - 2))) & U64(255)) % U64(split)
        order, home = _by_bucket(keys >> U64(8 * (depth - 1)) | third << U64(16), n_homes)
        keys, counts = keys[order], counts[order]
        rows = [(int(home[a]), key[0].as_py(), _pack_keys(keys[a:b]), _pack(counts[a:b])) for a, b in _edges(home)]
        return _table(list(zip(*rows)) or [[]] * 4, ["home", "bucket", "grams", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return jobs.tidy_group(run)


class _Level:
    """The nodes of one depth: for each number of known bits their keys, counts and estimates."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.node, self.zeros, self.ones, self.log_pe = [None] * 8, [None] * 8, [None] * 8, [None] * 8
        # from the most known bits to the fewest, so that each sums what the one before has
        child, total = keys, counts
        for b in range(7, -1, -1):
            node = child >> U64(1)
            new = np.concatenate(([True], node[1:] != node[:-1]))
            place = np.cumsum(new) - 1
            bit = (child & U64(1)).astype(bool)
            n = int(place[-1]) + 1
            zeros, ones = np.zeros(n, np.int64), np.zeros(n, np.int64)
            zeros[place[~bit]] = total[~bit]
            ones[place[bit]] = total[bit]
            self.node[b], self.zeros[b], self.ones[b], self.log_pe[b] = node[new], zeros, ones, log_kt(zeros, ones)
            child, total = self.node[b], zeros + ones

    def parent(self, b: int) -> np.ndarray:
        """Key of the node one depth up, with the same known bits."""
        return ((self.node[b] >> U64(b + 8)) << U64(b)) | (self.node[b] & U64((1 << b) - 1))


class _Subtree:
    """Depths 3 to `depth` of some whole contexts of three bytes: levels, each node's place one depth up, weights of its own estimate, and log P_w at depth 3."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.levels, self.up, self.weight = depth, {depth: _Level(keys, counts)}, {}, {}
        for d in range(depth - 1, 2, -1):
            self.levels[d] = _Level(*_grouped(((keys >> U64(8 * (depth - d + 1))) << U64(8)) | (keys & U64(255)), counts))
        log_pw = self.levels[depth].log_pe
        for d in range(depth - 1, 2, -1):
            own, below = self.levels[d], self.levels[d + 1]
            next_pw, self.weight[d], self.up[d + 1] = [], [], []
            for b in range(8):
                place = np.searchsorted(own.node[b], below.parent(b))
                children = np.bincount(place, log_pw[b], len(own.node[b]))
                next_pw.append(np.logaddexp(own.log_pe[b], children) - math.log(2))
                self.weight[d].append(1 / (1 + np.exp(np.clip(children - own.log_pe[b], -700, 700))))
                self.up[d + 1].append(place)
            log_pw = next_pw
        self.log_pw = log_pw


def _slices(keys: np.ndarray, depth: int):
    """Ranges of about _SLICE keys that hold whole contexts of three bytes."""
    three = keys >> U64(8 * (depth - 2))
    edge = np.append(np.flatnonzero(np.concatenate(([True], three[1:] != three[:-1]))), len(keys))
    lo = 0
    while lo < len(edge) - 1:
        hi = max(int(np.searchsorted(edge, edge[lo] + _SLICE, "right")) - 1, lo + 1)
        yield int(edge[lo]), int(edge[hi])
        lo = hi


def _second(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of two bytes, and for each its nodes in heap order: sum of the children's log P_w, zeros, ones."""
    context = np.unique(keys >> U64(8 * (depth - 1)))
    sums = np.zeros((len(context), 3, 256))
    for lo, hi in _slices(keys, depth):
        tree = _Subtree(keys[lo:hi], counts[lo:hi], depth)
        own = tree.levels[3]
        for b in range(8):
            at = np.searchsorted(context, own.node[b] >> U64(b + 8))
            heap = (own.node[b] & U64((1 << b) - 1)).astype(np.int64) + (1 << b)
            for k, x in enumerate((tree.log_pw[b], own.zeros[b], own.ones[b])):
                np.add.at(sums[:, k], (at, heap), x)
    return context, sums


def _mixed(children: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of nodes' own estimates, and their log P_w (0 where nothing was counted)."""
    log_pe = log_kt(zeros.astype(np.int64).ravel(), ones.astype(np.int64).ravel()).reshape(zeros.shape)
    v = 1 / (1 + np.exp(np.clip(children - log_pe, -700, 700)))
    return v, np.where(zeros + ones > 0, np.logaddexp(log_pe, children) - math.log(2), 0.0)


def _inverse(zeros: np.ndarray, ones: np.ndarray) -> list[np.ndarray]:
    """1 / (estimate of a zero, and of a one, from the counts without it); anything where there is none."""
    return [(zeros + ones) / (np.maximum(x, 1) - 0.5) for x in (zeros, ones)]


def _merged(table) -> tuple[np.ndarray, np.ndarray]:
    return _grouped(np.concatenate([_unpack_keys(x.as_py()) for x in table.column("grams")]), np.concatenate([_unpack(x.as_py(), np.int64) for x in table.column("counts")]))


def _summary(depth: int, n_buckets: int):
    """What a home has of its contexts of two bytes, by bucket of the context."""

    def run(key, table):
        context, sums = _second(*_merged(table), depth)
        order, bucket = _by_bucket(context, n_buckets)
        context, sums = context[order], sums[order]
        rows = [(int(bucket[a]), key[0].as_py(), context[a:b].tobytes(), sums[a:b].tobytes()) for a, b in _edges(bucket)]
        return _table(list(zip(*rows)), ["bucket", "home", "contexts", "sums"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return jobs.tidy_group(run)


def _whole(key, table):
    """Of a bucket of contexts of two bytes: to each home the sums over all homes, and by latest byte the sums over those of log P_w and the counts."""
    raw = [np.frombuffer(x.as_py(), U64) for x in table.column("contexts")]
    context, place = np.unique(np.concatenate(raw), return_inverse=True)
    sums = np.zeros((len(context), 3, 256))
    ends = np.cumsum([0, *map(len, raw)])
    for a, b, x in zip(ends[:-1], ends[1:], table.column("sums")):
        sums[place[a:b]] += np.frombuffer(x.as_py()).reshape(-1, 3, 256)
    _, log_pw = _mixed(*(sums[:, k] for k in range(3)))
    latest = (context >> U64(8)).astype(np.int64)
    total = np.zeros((256, 3, 256))
    for k, x in enumerate((log_pw, sums[:, 1], sums[:, 2])):
        np.add.at(total[:, k], latest, x)
    rows = [(home.as_py(), -1, x.tobytes(), sums[place[a:b]].tobytes()) for a, b, x, home in zip(ends[:-1], ends[1:], raw, table.column("home"))]
    rows += [(-1, int(i), None, total[i].tobytes()) for i in np.unique(latest)]
    return _table(list(zip(*rows)), ["home", "latest", "contexts", "sums"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def _add_doubles(parts: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(x) for x in parts], 0).tobytes()


def _top(rows) -> np.ndarray:
    """What depths 0 and 1 make of 1 / q of depth 2: [256, 256, 3] by latest byte and heap order.

    It becomes base + rest times it; base for a zero, base for a one, rest.
    """
    sums = np.zeros((256, 3, 256))
    for r in rows:
        sums[r["latest"]] += np.frombuffer(r["sums"]).reshape(3, 256)
    children, zeros, ones = sums[:, 0], sums[:, 1], sums[:, 2]
    v1, log_pw = _mixed(children, zeros, ones)
    v0, _ = _mixed(log_pw.sum(0), zeros.sum(0), ones.sum(0))
    out = np.empty((256, 256, 3))
    for k, (first, root) in enumerate(zip(_inverse(zeros, ones), _inverse(zeros.sum(0), ones.sum(0)))):
        out[:, :, k] = v0 * root + (1 - v0) * v1 * first
    out[:, :, 2] = (1 - v0) * (1 - v1)
    return out


def code_lengths(keys: np.ndarray, counts: np.ndarray, context: np.ndarray, sums: np.ndarray, top: np.ndarray, depth: int) -> np.ndarray:
    """Bits for the last byte of each key, given its context and all other occurrences; keys, counts and sums are all of a home."""
    bits = np.zeros(len(keys))
    v2, _ = _mixed(*(sums[:, k] for k in range(3)))
    second = _inverse(sums[:, 1], sums[:, 2])
    for lo, hi in _slices(keys, depth):
        tree = _Subtree(keys[lo:hi], counts[lo:hi], depth)
        own = keys[lo:hi]
        for b in range(8):
            leaf = tree.levels[depth]
            inverse = [None, None]
            known = (leaf.node[b] & U64((1 << b) - 1)).astype(np.int64)
            heap = known + (1 << b)
            two = leaf.node[b] >> U64(b + 8 * (depth - 2))
            at, latest = np.searchsorted(context, two), (two >> U64(8)).astype(np.int64)
            for k, x in enumerate(_inverse(leaf.zeros[b], leaf.ones[b])):
                place = np.arange(len(x))
                for d in range(depth - 1, 2, -1):
                    place = tree.up[d + 1][b][place]
                    v = tree.weight[d][b][place]
                    x = v * _inverse(tree.levels[d].zeros[b], tree.levels[d].ones[b])[k][place] + (1 - v) * x
                x = v2[at, heap] * second[k][at, heap] + (1 - v2[at, heap]) * x
                inverse[k] = np.log2(top[latest, heap, k] + top[latest, heap, 2] * x)
            place = np.searchsorted(leaf.node[b], own >> U64(8 - b))
            one = (own >> U64(7 - b)) & U64(1) == 1
            bits[lo:hi] += np.where(one, inverse[1][place], inverse[0][place])
    return bits


def _answer(top: np.ndarray, depth: int):
    """Code lengths of the n-grams of a home, by the bucket that they came from."""

    def run(key, table, about):
        keys, counts = _merged(table)
        context = np.concatenate([np.frombuffer(x.as_py(), U64) for x in about.column("contexts")])
        sums = np.concatenate([np.frombuffer(x.as_py()).reshape(-1, 3, 256) for x in about.column("sums")])
        order = np.argsort(context)
        context, sums = context[order], sums[order]
        bits = code_lengths(keys, counts, context, sums, top, depth).astype(np.float32)
        answers = [_pack(bits[np.searchsorted(keys, _unpack_keys(x.as_py()))]) for x in table.column("grams")]
        return _table([table.column("bucket").combine_chunks(), table.column("grams").combine_chunks(), answers], ["bucket", "grams", "bits"], [pa.int32(), pa.binary(), pa.binary()])

    return jobs.tidy_cogroup(run)


def _reply(key, asked, answers):
    """Code lengths for each request of a bucket, in the order of its n-grams."""
    keys = np.concatenate([_unpack_keys(x.as_py()) for x in answers.column("grams")])
    bits = np.concatenate([_unpack(x.as_py(), np.float32) for x in answers.column("bits")])
    order = np.argsort(keys)
    keys, bits = keys[order], bits[order]
    replies = [_pack(bits[np.searchsorted(keys, _unpack_keys(x.as_py()))]) for x in asked.column("grams")]
    return _table([asked.column("part").combine_chunks(), asked.column("bucket").combine_chunks(), replies], ["part", "bucket", "bits"], [pa.int32(), pa.int32(), pa.binary()])


def _add_up(depth: int, n_buckets: int):
    """Sums by document. The part's n-grams are those that it asked for, in the same order."""

    def run(key, docs, replies):
        ids = docs.column("id")
        buf, off = texts.text_buffer(docs.column("text"))
        del docs
        total = np.zeros(len(off) - 1)
        if len(buf):
            row = np.argsort(replies.column("bucket").to_numpy())
            raw = replies.column("bits").combine_chunks()
            told = np.concatenate([_unpack(raw[int(i)].as_py(), np.float32) for i in row])
            del replies, raw
            keys = _part_keys(buf, off, depth)
            order, _ = _by_bucket(keys, n_buckets)
            bits = np.empty(len(keys), np.float32)
            bits[order] = told
            del order, told
            for lo, hi in _chunks(off):
                own = _keys(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], depth)
                order = np.argsort(own)
                own = own[order]
                at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                each = np.empty(len(own))
                each[order] = np.repeat(bits[np.searchsorted(keys, own[at])], np.diff(np.append(at, len(own))))
                upto = np.concatenate(([0.0], np.cumsum(each)))[off[lo : hi + 1] - off[lo]]
                total[lo:hi] = np.diff(upto)
        size = np.diff(off)
        per = np.round(total / np.maximum(size, 1), 6)
        return pa.table({"id": ids, "n_bytes": pa.array(size), "code_bits": pa.array(np.round(total, 3)), "bits_per_byte": pa.array(per, mask=size == 0)})

    return jobs.tidy_cogroup(run)


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, code_bits, bits_per_byte) of each row under the tree of all rows.

    A byte's code length is that given all other bytes of all rows, itself left
    out (see above). So text that nothing else resembles is long, and a document
    that occurs twice is short, as each of the two predicts the other.

    depth: bytes of context, from 3 to 7. NULL and empty texts have 0 bytes, 0
    bits and NULL bits per byte. Rows without id are scored too; repeated rows
    each count in the tree and are each scored. Text bytes are those of UTF-8.
    Other columns are ignored. No documents: no rows.
    """
    if not 3 <= depth <= 7:
        raise ValueError("depth must be from 3 to 7")
    spark = docs.sparkSession
    base = jobs.picked(docs, id=id_col, text=text_col).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, count = max(1, -(-size // _PART_BYTES)), jobs.buckets(spark)
    split = min(256, max(1, -(-size // _SPLIT_BYTES)))
    base = base.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))
    asked = base.select("part", "text").groupBy("part").applyInArrow(_count_part(depth, count), "part int, bucket int, grams binary, counts binary")
    asked = jobs.saved(asked, "grams")
    sums = asked.select("bucket", "grams", "counts").groupBy("bucket").applyInArrow(_combine(depth, count, split), "home int, bucket int, grams binary, counts binary")
    sums = jobs.saved(sums, "gram-sums")
    about = sums.select("home", "grams", "counts").groupBy("home").applyInArrow(_summary(depth, count), "bucket int, home int, contexts binary, sums binary")
    about = jobs.saved(about.groupBy("bucket").applyInArrow(jobs.tidy_group(_whole), "home int, latest int, contexts binary, sums binary"), "gram-contexts")
    top = jobs.folded(about.where("latest >= 0").select(F.col("latest").alias("slice"), F.col("sums").alias("data")), _add_doubles)
    top = _top(top.select(F.col("slice").alias("latest"), F.col("data").alias("sums")).collect())  # of each latest byte 6 KB
    contexts = about.where("latest < 0").select("home", "contexts", "sums")
    answers = sums.groupBy("home").cogroup(contexts.groupBy("home")).applyInArrow(_answer(top, depth), "bucket int, grams binary, bits binary")
    replies = asked.select("part", "bucket", "grams").groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(jobs.tidy_cogroup(_reply), "part int, bucket int, bits binary")
    kind = base.schema["id"].dataType.simpleString()
    out = base.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_add_up(depth, count), f"id {kind}, n_bytes long, code_bits double, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)
