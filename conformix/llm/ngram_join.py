"""N-gram Jaccard self-join: pairs of documents whose sets of word n-grams overlap.

The overlap counts are a sparse matrix product A A' of the n-gram incidence
matrix A, whose rows are the distinct sets of n-grams ("classes": documents with
equal sets share one). It is computed in blocks, and rows and pairs that the
sizes rule out are discarded before and during the product:

1. A table of n-gram counts by hash slot, over all documents, fixes one global
   order of n-grams, common ones last.
2. Of n n-grams, a set that reaches t with another misses n - ceil(t n) at most,
   so of its first x in the order it shares x - (n - ceil(t n)) or more. Only the
   first x = n - ceil(t n) + ceil((1 - t) n / 2) + 1 are shuffled, as packed arrays
   by hash bucket. The lowest class of a size range with an n-gram owns it there.
3. Classes that share fewer of them with classes of sizes within the factor t are
   dropped. The others visit the blocks of some of their owners: as a linked pair
   shares (1 - t) n / 2 + 1 or more, each may leave out owners of less than half as many
   (see _choose). Copies of one text mostly have one owner in common, so most
   classes are in one block. A block of more than `block_rows` is split into
   squares of its matrix.
4. Within a block, columns of one row are dropped, then rows left with fewer
   than ceil(t n) columns, until nothing changes. What is left is multiplied
   slab by slab, rows sorted by size, skipping rows whose sizes differ by more
   than the factor t, and pairs below o >= t / (1 + t) (n_a + n_b) are discarded.
   The product is sparse but for columns that much of a block has.

The result is exact but for collisions of 60-bit hashes of n-grams, and of 48-bit
hashes of two sets that would be linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs, texts
from .components import components

U64 = np.uint64
#: Slots of n-gram counts: 2^17 up to 1 GB of text, and 2^21 (2 MiB of levels) at most.
_SLOT_BITS = (17, 21)
_SLICES = 16
_NONE = np.iinfo(np.int64).min
#: Until blocks are made, classes are known by 48 bits. Those of equal numbers are taken for
#: one, of the smaller size; they meet all that they need to, though not each other.
_NUMBER, _NUMBERS = 6, (1 << 48) - 1
_EMIT_KEYS = 500_000
_FLUSH_GRAMS = 2_000_000
#: Columns of a block that one row in so many has are multiplied densely.
_HEAVY = 10
#: Products of the sparse part that are added up at once.
_PRODUCTS = 4_000_000


def _gram_sets(buf: np.ndarray, off: np.ndarray, n: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row in the global order, and offsets by row."""
    words = texts.Words(buf, off)
    h, goff = texts.gram_hashes(words.hashed(), words.first, n)
    keys = (levels[h >> U64(65 - len(levels).bit_length())].astype(U64) << U64(60)) | (h >> U64(4))
    for a, b in zip(goff[:-1].tolist(), goff[1:].tolist()):
        if b - a > 1:
            keys[a:b].sort()
    if not len(keys):
        return keys, goff
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[goff[:-1][np.diff(goff) > 0]] = True
    upto = np.zeros(len(keys) + 1, np.int64)
    np.cumsum(new, out=upto[1:])
    return keys[new], upto[goff]


def _need(n: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of a set of n with any set that reaches t."""
    return np.ceil(t * n - 1e-9).astype(np.int64)


def _survey(n: int, bits: int):
    """n-gram counts by hash slot (slice >= 0), and ids, classes and sizes of documents (slice -1)."""
    plain = np.zeros(1 << bits, np.uint8)
    names = ["slice", "data", "classes", "sizes"]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part, buf, off in texts.chunks(batch, "text"):
                keys, goff = _gram_sets(buf, off, n, plain)
                counts += np.bincount((keys >> U64(60 - bits)).astype(np.int64), minlength=len(counts))
                row = (-1, part.column(0).to_numpy(zero_copy_only=False).tobytes(), _class_of(keys, goff).tobytes(), np.diff(goff).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, _SLICES)], pa.binary()), pa.nulls(_SLICES, pa.binary()), pa.nulls(_SLICES, pa.binary())], names)

    return jobs.tidy(run)


def _class_of(keys: np.ndarray, goff: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set of keys; equal sets have equal numbers."""
    total = np.zeros(len(keys) + 1, U64)
    np.cumsum(texts.mix(keys & U64((1 << 60) - 1)), out=total[1:])
    return texts.mix(total[goff[1:]] - total[goff[:-1]] + np.diff(goff).astype(U64)).view(np.int64)


def _documents(batches):
    """Unpacks the documents of _survey."""
    for batch in batches:
        ids, classes, sizes = ([np.frombuffer(x.as_py(), np.int64) for x in batch.column(c)] for c in (1, 2, 3))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, classes, sizes)], ["id", "class", "n"])


def _levels(survey: DataFrame, bits: int) -> np.ndarray:
    """A level from 0 to 15 for each hash slot: how far its n-grams exceed the usual count.

    Sent to the tasks, it has one byte for each of the 2^bits slots.
    """
    rows = jobs.folded(survey.where("slice >= 0").select("slice", "data"), jobs.add_longs).collect()
    counts = np.zeros((_SLICES, (1 << bits) // _SLICES), np.int64)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["data"], np.int64)
    counts = counts.ravel()
    usual = max(1.0, float(np.median(counts)))
    return np.clip(np.floor(2 * np.log2(np.maximum(counts / usual, 1))), 0, 15).astype(np.uint8)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of whole numbers, bytes of one place together: what is zero or alike compresses."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return wide.view("<i8").ravel()


def _ascending(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=0), _NUMBER)


def _from_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, _NUMBER))


class _Packer:
    """Collects sets' keys and packs them into rows by bucket: keys of 32 bits, and once
    for each class its number, its count of keys and its size. Of equal sets one is sent."""

    names = ["bucket", "keys", "classes", "counts", "sizes"]
    schema = "bucket int, keys binary, classes binary, counts binary, sizes binary"

    def __init__(self, n_buckets: int):
        self.n_buckets, self.pend, self.size = n_buckets, [], 0

    def put(self, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> None:
        """keys: of one set after the other; the rest: by set."""
        if len(keys):
            self.pend.append((keys, counts, classes, sizes))
            self.size += len(keys)

    def batch(self) -> pa.RecordBatch:
        keys, counts, classes, sizes = (np.concatenate(x) for x in zip(*self.pend))
        self.pend, self.size = [], 0
        _, one = np.unique(classes, return_index=True)
        one = one[np.argsort(classes[one] & _NUMBERS, kind="stable")]
        h = texts.mix(keys[texts.ranges((np.cumsum(counts) - counts)[one], counts[one])])
        row, classes, sizes = np.repeat(np.arange(len(one), dtype=np.int32), counts[one]), classes[one] & _NUMBERS, sizes[one]
        part = (h % U64(self.n_buckets)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if self.n_buckets < 1 << 16 else part, kind="stable")
        short, row, part = (h >> U64(32)).astype("<u4")[order], row[order], part[order]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        rows = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
            first = np.flatnonzero(np.concatenate(([True], row[a + 1 : b] != row[a : b - 1])))
            own = row[a:b][first]
            rows.append((int(part[a]), short[a:b].tobytes(), _ascending(classes[own]), _planes(np.diff(np.append(first, b - a)), 4), _planes(sizes[own], 4)))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], self.names)


def _head(n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first keys of a set of n are sent, and how many of them a pair that reaches t shares at least.

    Half as many as the set may miss are sent beyond those. Two sets share as many as the larger of both asks, whatever their sizes:
    where the head that ends first in the global order ends, the other has all
    shared keys up to there, and what one misses of the other is bounded by both sizes.
    """
    spare = np.ceil((1 - t) / 2 * n - 1e-9).astype(np.int64) + 1
    return np.minimum(n, n - _need(n, t) + spare), np.minimum(spare, _need(n, t))


def _heads(n: int, t: float, levels: np.ndarray, n_buckets: int):
    """The first x keys of each set, packed."""

    def run(batches):
        packer = _Packer(n_buckets)
        for batch in batches:
            for _, buf, off in texts.chunks(batch, "text"):
                keys, goff = _gram_sets(buf, off, n, levels)
                count = np.diff(goff)
                take, _ = _head(count, t)
                packer.put(keys[texts.ranges(goff[:-1], take)], take, _class_of(keys, goff), count)
                if packer.size >= _EMIT_KEYS:
                    yield packer.batch()
        if packer.size:
            yield packer.batch()

    return jobs.tidy(run)


def _shared(table, t: float):
    """Keys that classes of sizes within the factor t share: class, its size, number of
    the run and lowest class of the run, for each member of each run.

    The classes with a key are sorted by size and cut where the next is more than
    1 / t times as large, as no pair across such a gap can reach t.
    """
    keys = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("keys")]).astype(U64)
    counts = [_from_planes(x.as_py(), 4) for x in table.column("counts")]
    classes = np.concatenate([np.repeat(_from_ascending(i.as_py()), c) for i, c in zip(table.column("classes"), counts)])
    sizes = np.concatenate([np.repeat(_from_planes(i.as_py(), 4), c) for i, c in zip(table.column("sizes"), counts)])
    order = np.argsort((keys << U64(32)) | sizes.view(U64))
    keys, classes, sizes = keys[order], classes[order], sizes[order]
    cut = np.ones(len(keys), bool)
    cut[1:] = (keys[1:] != keys[:-1]) | (sizes[1:] * t > sizes[:-1] + 1e-6)
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, len(keys)))
    least, most = np.minimum.reduceat(classes, at), np.maximum.reduceat(classes, at)
    some = least < most
    rows = texts.ranges(at[some], length[some])
    return classes[rows], sizes[rows], np.repeat(np.flatnonzero(some), length[some]), np.repeat(least[some], length[some])


def _tally(n_parts: int, t: float):
    """For each class of a bucket how many of its keys each owner has, packed by class."""

    def run(key, table):
        classes, sizes, run_, owners = _shared(table, t)
        order = np.lexsort((run_, owners, classes))
        classes, sizes, run_, owners = classes[order], sizes[order], run_[order], owners[order]
        new = np.ones(len(run_), bool)  # copies of a document send the same keys
        new[1:] = (run_[1:] != run_[:-1]) | (owners[1:] != owners[:-1]) | (classes[1:] != classes[:-1])
        classes, sizes, owners = classes[new], sizes[new], owners[new]
        first = np.flatnonzero(np.concatenate(([True], (classes[1:] != classes[:-1]) | (owners[1:] != owners[:-1])))) if len(classes) else np.zeros(0, np.int64)
        sizes = np.minimum.reduceat(sizes, first) if len(first) else sizes
        count, classes, owners = np.diff(np.append(first, len(classes))), classes[first], owners[first]
        part = classes % n_parts
        order = np.argsort(part, kind="stable")
        part = part[order]
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist() if len(part) else []
        classes, owners, count, sizes = classes[order], owners[order], count[order], sizes[order]
        rows = [(int(part[a]), _ascending(classes[a:b]), _planes(owners[a:b], _NUMBER), _planes(count[a:b], 4), _planes(sizes[a:b], 4)) for a, b in zip(edge, edge[1:])]
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "classes", "owners", "counts", "sizes"])

    return jobs.tidy_group(run)


def _choose(t: float):
    """(number of a class, owner): the owners at which a class meets all that it can be linked to.

    A class that shares fewer keys than the bound asks has no link. Any linked
    pair shares `need` keys or more, so if each class leaves less than half of
    its own `need` to owners that it doesn't visit, one shared key's owner is
    visited by both. The owners of most keys are taken until no more are left.
    """

    def run(key, table):
        classes = np.concatenate([_from_ascending(x.as_py()) for x in table.column("classes")])
        owners, counts, sizes = (np.concatenate([_from_planes(x.as_py(), width) for x in table.column(c)]) for c, width in (("owners", _NUMBER), ("counts", 4), ("sizes", 4)))
        order = np.lexsort((owners, classes))
        classes, owners, counts, sizes = classes[order], owners[order], counts[order], sizes[order]
        first = np.flatnonzero(np.concatenate(([True], (classes[1:] != classes[:-1]) | (owners[1:] != owners[:-1]))))
        counts, classes, owners, sizes = np.add.reduceat(counts, first), classes[first], owners[first], np.minimum.reduceat(sizes, first)
        order = np.lexsort((owners, -counts, classes))
        counts, classes, owners, sizes = counts[order], classes[order], owners[order], sizes[order]
        first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
        length = np.diff(np.append(first, len(classes)))
        before = np.cumsum(counts) - counts
        before -= np.repeat(before[first], length)
        total = np.repeat(np.add.reduceat(counts, first), length)
        need = _head(np.repeat(np.minimum.reduceat(sizes, first), length), t)[1]
        keep = (total >= need) & (before < total - (need - 1) // 2)
        return pa.table({"number": classes[keep], "owner": owners[keep]})

    return jobs.tidy_group(run)


def _sets(n: int, levels: np.ndarray):
    """Packed sets of documents."""

    def run(batches):
        for batch in batches:
            for part, buf, off in texts.chunks(batch, "text"):
                keys, goff = _gram_sets(buf, off, n, levels)
                grams = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(goff) - 1, [None, pa.py_buffer(goff * 8), pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_class_of(keys, goff)), grams], ["id", "class", "grams"])

    return jobs.tidy(run)


def _overlaps(row: np.ndarray, col: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows a < b with the overlap that t asks for; rows must be sorted by n.

    The sparse product of the incidence matrix with its transpose, by slabs of
    rows: each entry of a slab adds 1 for each later row of its column, as far as
    sizes are within the factor t. Columns that at least 1 / _HEAVY of the rows
    have, as near copies of one text do, are multiplied as dense panels instead.
    """
    m, width, height = len(n), 1024, 512
    order = np.lexsort((row, col))
    row, col = row[order], col[order]
    length = np.bincount(col)
    heavy = length * _HEAVY >= m
    thick = heavy[col]
    panel_row, panel_col = row[thick], _compact(col[thick])
    k = int(panel_col[-1]) + 1 if len(panel_col) else 0
    edges = np.searchsorted(panel_col, np.arange(0, k + width, width))
    row, col = row[~thick], col[~thick]
    end = np.cumsum(np.where(heavy, 0, length))
    by_row = np.argsort(row, kind="stable")
    slab = np.searchsorted(row[by_row], np.arange(0, m + height, height))
    found = []
    for s, lo in enumerate(range(0, m, height)):
        hi = min(lo + height, m)
        top = int(np.searchsorted(n, n[hi - 1] / t + 1e-9, "right"))
        acc = np.zeros((hi - lo, top - lo), np.float32)
        for c, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            r, x = panel_row[a:b], panel_col[a:b] - c * width
            use = (r >= lo) & (r < top)
            if not use.any():
                continue
            dense = np.zeros((top - lo, min(width, k - c * width)), np.float32)
            dense[r[use] - lo, x[use]] = 1
            acc += dense[: hi - lo] @ dense.T
        own = by_row[slab[s] : slab[s + 1]]
        later = end[col[own]] - own - 1
        own, later = own[later > 0], later[later > 0]
        upto = np.cumsum(later)
        a = 0
        while a < len(own):
            b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PRODUCTS, "right")), a + 1)
            i, j = np.repeat(row[own[a:b]], later[a:b]) - lo, row[texts.ranges(own[a:b] + 1, later[a:b])]
            near = j < top
            acc += np.bincount(i[near] * (top - lo) + j[near] - lo, minlength=acc.size).reshape(acc.shape)
            a = b
        # o >= t * union, as o (1 + t) >= t * (sum of both sizes); acc holds whole numbers
        i, j = np.nonzero(acc > 0)
        later = i < j
        i, j = i[later], j[later]
        o = np.rint(acc[i, j]).astype(np.int64)
        keep = o >= t * (n[i + lo] + n[j + lo] - o) - 1e-6
        found.append((i[keep] + lo, j[keep] + lo, o[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _labels(m: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Lowest id connected to each of m nodes by the edges a-b."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def _multiply(groups: np.ndarray, table: pa.Table, t: float, star: bool) -> list[np.ndarray]:
    """Pairs of all complete blocks in the table, or with `star` for each class its links
    that no other block counts and the lowest document that it is connected to;
    groups: number of each row's block."""
    ids = table.column("class").to_numpy()
    owner = table.column("owner").to_numpy()
    slab = table.column("slab").to_numpy()
    whole = table.column("lo").to_numpy() == table.column("hi").to_numpy()
    grams = table.column("grams").combine_chunks()
    n = (np.diff(np.frombuffer(grams.buffers()[1], np.int32, len(grams) + 1, grams.offset * 4)) // 8).astype(np.int64)
    start = int(np.frombuffer(grams.buffers()[1], np.int32, 1, grams.offset * 4)[0])
    keys = np.frombuffer(grams.buffers()[2], U64, int(n.sum()), start) if n.sum() else np.zeros(0, U64)
    lists = table.column("owners").combine_chunks()
    owners, owners_off = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    lowest = table.column("first").to_numpy()
    row = np.repeat(np.arange(len(ids), dtype=np.int64), n)
    h = texts.mix(keys ^ texts.mix(groups[row].astype(U64)))
    order = np.argsort(h)
    h = h[order]
    col = np.empty(len(h), np.int64)
    col[order] = np.cumsum(np.concatenate(([False], h[1:] != h[:-1]))) if len(h) else 0
    del h, order
    need = _need(n, t)
    while True:
        keep = np.bincount(col, minlength=1)[col] >= 2
        alive = np.bincount(row[keep], minlength=len(ids)) >= need
        keep &= alive[row]
        if keep.all():
            break
        row, col = row[keep], col[keep]
        if not len(row):
            return []
        _, col = np.unique(col, return_inverse=True) if len(col) < 1000 else (None, _compact(col))
    out = []
    rows = np.flatnonzero(np.bincount(row, minlength=len(ids)))
    by_group = np.flatnonzero(np.concatenate(([True], groups[rows][1:] != groups[rows][:-1])))
    element = np.searchsorted(row, rows)
    element = np.append(element, len(row))
    for a, b in zip(by_group.tolist(), [*by_group[1:].tolist(), len(rows)]):
        if b - a < 2:
            continue
        own = rows[a:b]
        own_n = n[own]
        rank = np.argsort(own_n, kind="stable")
        place = np.empty(len(own), np.int64)
        place[rank] = np.arange(len(own))
        lo, hi = element[a], element[b]
        r = place[np.repeat(np.arange(len(own)), np.diff(element[a : b + 1]))]
        i, j, o = _overlaps(r, _compact(col[lo:hi]), own_n[rank], t)
        if not len(i):
            continue
        i, j = own[rank[i]], own[rank[j]]
        jac = o / (n[i] + n[j] - o)
        use = jac >= t
        if not whole[own[0]]:
            use &= slab[i] != slab[j]
        i, j, o, jac = i[use], j[use], o[use], jac[use]
        # of the blocks where both documents meet, the one of their lowest common owner reports them
        low = np.full(len(i), True)
        me = int(owner[own[0]])
        width = int(np.diff(owners_off)[own].max())
        padded = np.full((len(own), width), _NONE, np.int64)
        for q in range(width):
            at = owners_off[own] + q
            ok = at < owners_off[own + 1]
            padded[ok, q] = owners[at[ok]]
        pi, pj = np.searchsorted(own, i), np.searchsorted(own, j)
        for q in range(width):
            x = padded[pi, q]
            earlier = (x != _NONE) & (x < me) & low
            if earlier.any():
                e = np.flatnonzero(earlier)
                low[e] &= ~(padded[pj[e]] == x[e, None]).any(1)
        if star:
            if len(i):
                at, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
                links = np.bincount(inv[np.concatenate([low, low])], minlength=len(at))
                out.append((ids[at], links, _labels(len(at), inv[: len(i)], inv[len(i) :], lowest[at])))
            continue
        i, j, o, jac = i[low], j[low], o[low], jac[low]
        swap = lowest[i] > lowest[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out.append((lowest[i], lowest[j], o, n[i], n[j], jac))
    return [np.concatenate(x) for x in zip(*out)] if out else []


def _compact(x: np.ndarray) -> np.ndarray:
    """The same labels renumbered from 0 without gaps."""
    if not len(x):
        return x
    seen = np.zeros(int(x.max()) + 1, bool)
    seen[x] = True
    return (np.cumsum(seen) - 1)[x]


_PAIR = "id_a long, id_b long, overlap long, size_a long, size_b long, jaccard double"
_STAR = "class long, links long, root long"


def _products(t: float, star: bool):
    names = ["class", "links", "root"] if star else ["id_a", "id_b", "overlap", "size_a", "size_b", "jaccard"]

    def run(batches):
        pend: list[pa.Table] = []
        size = 0

        def work(table: pa.Table):
            o, lo, hi = (table.column(c).to_numpy() for c in ("owner", "lo", "hi"))
            change = (o[1:] != o[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            groups = np.concatenate(([0], np.cumsum(change)))
            # repeated rows of one document come more than once
            classes = table.column("class").to_numpy()
            order = np.lexsort((classes, groups))
            same = (groups[order[1:]] == groups[order[:-1]]) & (classes[order[1:]] == classes[order[:-1]])
            if same.any():
                keep = np.ones(len(groups), bool)
                keep[order[1:][same]] = False
                table, groups = table.filter(pa.array(keep)).combine_chunks(), groups[keep]
            got = _multiply(groups, table, t, star)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], names) if got else None

        for batch in batches:
            if not batch.num_rows:
                continue
            pend.append(pa.Table.from_batches([batch]))
            size += batch.nbytes // 8
            if size < _FLUSH_GRAMS:
                continue
            table = pa.concat_tables(pend).combine_chunks()
            o, lo, hi = (table.column(c).to_numpy() for c in ("owner", "lo", "hi"))
            same = (o == o[-1]) & (lo == lo[-1]) & (hi == hi[-1])
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                got = work(table.slice(0, last).combine_chunks())
                if got is not None:
                    yield got
            pend = [table.slice(last).combine_chunks()]
            size = pend[0].nbytes // 8
        if pend:
            got = work(pa.concat_tables(pend).combine_chunks())
            if got is not None:
                yield got

    return jobs.tidy(run)


def _blocked(docs: DataFrame, threshold: float, n: int, block_rows: int, id_col: str, text_col: str, star: bool) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(id, class, n) of each document, (class, first, size) of each class, the blocks' results, and the tables those are read from."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = docs.sparkSession
    base = jobs.picked(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    count = 2 * jobs.buckets(spark)  # groups of a few megabytes
    volume = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(_SLOT_BITS[0], (volume >> 13).bit_length()), _SLOT_BITS[1])
    survey = jobs.saved(base.mapInArrow(_survey(n, bits), "slice int, data binary, classes binary, sizes binary"), "survey")
    levels = _levels(survey, bits)
    entries = jobs.saved(survey.where("slice < 0").mapInArrow(_documents, "id long, class long, n long").distinct(), "entries")
    jobs.discard(survey)
    classes = jobs.saved(entries.where("n > 0").groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("size")), "classes")

    heads = base.mapInArrow(_heads(n, threshold, levels, count), _Packer.schema)
    tallies = heads.groupBy("bucket").applyInArrow(_tally(count, threshold), "part int, classes binary, owners binary, counts binary, sizes binary")
    owned = jobs.saved(tallies.groupBy("part").applyInArrow(_choose(threshold), "number long, owner long"), "owners")
    numbered = classes.select("class", "first", F.col("class").bitwiseAND(F.lit(_NUMBERS)).alias("number"))
    several = owned.groupBy("owner").count().where("count > 1").select("owner", F.ceil(F.col("count") / block_rows).cast("int").alias("slabs"))
    placed = owned.join(several, "owner").withColumn("slab", F.pmod(F.xxhash64("number"), F.col("slabs")).cast("int"))
    block = F.transform(F.sequence(F.lit(0), F.col("slabs") - 1), lambda j: F.struct(F.col("owner"), F.least("slab", j).alias("lo"), F.greatest("slab", j).alias("hi"), F.col("slab")))
    placed = placed.groupBy("number").agg(F.sort_array(F.collect_set("owner")).alias("owners"), F.flatten(F.collect_list(block)).alias("blocks"))
    about = jobs.saved(placed.join(numbered, "number").drop("number"), "blocks")
    # few others pass the filter; they fall out of the join with `about`
    own = jobs.only(base, about.select(F.col("first").alias("id")))
    sets = own.mapInArrow(_sets(n, levels), "id long, class long, grams binary")
    blocks = sets.join(about, "class").where("id = first")
    blocks = blocks.select("class", "owners", "first", F.explode("blocks").alias("b"), "grams").select("b.owner", "b.lo", "b.hi", "b.slab", "class", "owners", "first", "grams")
    blocks = blocks.repartition("owner", "lo", "hi").sortWithinPartitions("owner", "lo", "hi")
    return entries, classes, blocks.mapInArrow(_products(threshold, star), _STAR if star else _PAIR), [owned, about]


def class_pairs(docs: DataFrame, threshold: float = 0.7, n: int = 3, block_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All links between classes, documents of equal n-gram sets being one class.

    Returns id_a < id_b, the lowest documents of two classes whose sets have a
    Jaccard index >= threshold, with overlap, size_a, size_b and jaccard. Rows as
    in ngram_jaccard_join.
    """
    return _blocked(docs, threshold, n, block_rows, id_col, text_col, False)[2]


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.7, n: int = 3, block_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its class, its links and its group under the word n-gram Jaccard join.

    Documents of equal n-gram sets are one class. Two classes are linked if the
    Jaccard index of their sets is >= threshold; all links are found and counted,
    with no cap on partners, and classes connected by links are one group. Returns

        id, class_id    the lowest document of its class
        n_copies        other documents of the class
        n_links         other classes that its class is linked to
        group_id        the lowest document of its group

    so the result grows with documents, however large groups of copies are. The
    links themselves are class_pairs.

    Words are those of `texts`. A text of fewer than n words, but one at least,
    has the one n-gram of all its words. A NULL or empty text, or one without
    words, has none: it is alone in its class. Rows with NULL id are left out. Of
    rows that repeat an id, those of equal sets are one document, and the others
    each have a row. Very long texts and ties need no special case. Other columns
    are ignored, whatever their names. No documents: no rows.
    """
    entries, classes, found, used = _blocked(docs, threshold, n, block_rows, id_col, text_col, True)
    found = jobs.saved(found.groupBy("class").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots")).join(classes, "class"), "links")
    jobs.discard(*used)
    groups = components(found.select(F.col("first").alias("a"), F.explode("roots").alias("b")))
    about = classes.join(found.select("class", "links"), "class", "left").join(groups.withColumnRenamed("id", "first"), "first", "left")
    out = entries.where("n > 0").join(about, "class")
    out = out.select("id", F.col("first").alias("class_id"), (F.col("size") - 1).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("group", "first").alias("group_id"))
    alone = entries.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("id").alias("group_id"))
    return out.union(alone).withColumnRenamed("id", id_col)
