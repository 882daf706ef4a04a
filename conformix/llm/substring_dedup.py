"""Removal of word sequences that an earlier document has already.

A word of a document goes if it lies in some window of `min_words` words that
also occurs in a document with a smaller id; that is, what goes is the union of
the maximal spans of at least `min_words` words that such documents share.

Automata of everything can't be sent to every task: they'd grow with the corpus.
So the reference is cut into shards, and only documents that can match a shard
are streamed through its automaton:

1. Winnowing picks fingerprints, hashes of half-length windows, so that any
   window of `min_words` words holds one, and equal windows hold the same ones.
2. The lowest document with a fingerprint owns it. Around each fingerprint that
   documents share, the region in which a window could match goes to the shard
   of the owner.
3. A shard's suffix automaton grows in the order of document ids: each document
   is streamed for matching statistics against what earlier ones put there, and
   then adds the windows that were new. Copies cost one pass, or a lookup.
4. A shard of more than `shard_rows` documents, which one task couldn't stream, is
   taken by windows instead: the least document of each window's hash, which is
   combined before the shuffle, is joined back to the windows. So a passage that a
   third of all documents have costs as much for each of them as any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jobs, texts

U64 = np.uint64
_EMIT_BYTES = 24 << 20


class SuffixAutomaton:
    """Suffix automaton of several integer sequences, for matching statistics."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        """Adds one sequence. No match runs across the border of two sequences."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def matches(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Runs [a, b) of positions at which a match of `least` or more ends."""
        nxt, link, length = self.next, self.link, self.length
        state = run = 0
        found, began = [], -1
        for i, c in enumerate(sequence):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                run += 1
            if run >= least:
                if began < 0:
                    began = i
            elif began >= 0:
                found.append((began, i))
                began = -1
        if began >= 0:
            found.append((began, len(sequence)))
        return found


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i at which the window is whole."""
    have, size = x, 1
    while size * 2 <= width:
        have = op(have[:-size], have[size:])
        size *= 2
    return have if size == width else op(have[: len(x) - width + 1], have[width - size : len(x) - size + 1])


def _fingerprints(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: the least k-gram hash of each window of `least` words."""
    k = max(1, least // 2)
    n, width = len(words), least - k + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(n - k + 1)
    h = texts.range_hash(words, at, at + k) | U64(1)
    low = _sliding(h, width, np.minimum)  # by start of the window of `least` words
    whole = np.zeros(n + 1, np.int64)
    count = np.diff(first)
    begin, end = first[:-1][count >= least], first[1:][count >= least] - least + 1
    np.add.at(whole, begin, 1)
    np.add.at(whole, end, -1)
    low[np.cumsum(whole)[: len(low)] == 0] = 0
    padded = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)])
    chosen = _sliding(padded, width, np.maximum)[: len(h)] == h
    at = np.flatnonzero(chosen)
    return at, h[at]


def _emit(least: int, n_buckets: int):
    """Rows (bucket, keys: 32 bits each, ids, hashes of texts, how many keys each has)."""

    def run(batches):
        pend, size = [], 0

        def flush():
            h, ids, th = (np.concatenate(x) for x in zip(*pend))
            part = (h % U64(n_buckets)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if n_buckets < 1 << 16 else part, kind="stable")
            short, ids, th, part = (h >> U64(32)).astype(np.uint32)[order], ids[order], th[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rows = []
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
                first = np.flatnonzero(np.concatenate(([True], (ids[a:b][1:] != ids[a:b][:-1]) | (th[a:b][1:] != th[a:b][:-1]))))
                rows.append((int(part[a]), short[a:b].tobytes(), ids[a:b][first].tobytes(), th[a:b][first].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes()))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "keys", "ids", "hashes", "counts"])

        for batch in batches:
            for part, buf, off in texts.chunks(batch, "text"):
                words = texts.Words(buf, off)
                at, h = _fingerprints(words.hashed(), words.first, least)
                if not len(at):
                    continue
                row = np.searchsorted(words.first, at, "right") - 1
                pend.append((h, part.column(0).to_numpy(zero_copy_only=False)[row], part.column(1).to_numpy(zero_copy_only=False)[row]))
                size += len(buf)
                if size >= _EMIT_BYTES:
                    yield flush()
                    pend, size = [], 0
        if pend:
            yield flush()

    return jobs.tidy(run)


_OWNED = "id long, hash long, bucket int, keys binary, owners array<long>"


def _owned(key, table):
    """For each document of a bucket its keys that several ids share, with their owners."""
    bucket = key[0].as_py()
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")])
    counts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]
    ids, hashes = (np.concatenate([np.repeat(np.frombuffer(i.as_py(), np.int64), c) for i, c in zip(table.column(name), counts)]) for name in ("ids", "hashes"))
    del table
    packed = np.sort((keys.astype(U64) << U64(32)) | np.arange(len(keys), dtype=U64))
    place = (packed & U64(0xFFFFFFFF)).astype(np.int64)
    key, ids, hashes = (packed >> U64(32)).astype(np.uint32), ids[place], hashes[place]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(at, len(key)))
    least, most = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
    shared = least < most
    rows = texts.ranges(at[shared], length[shared])
    key, ids, hashes, owner = key[rows], ids[rows], hashes[rows], np.repeat(least[shared], length[shared])
    order = np.lexsort((key, hashes, ids))
    key, ids, hashes, owner = key[order], ids[order], hashes[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (key[1:] != key[:-1])
    key, ids, hashes, owner = key[new], ids[new], hashes[new], owner[new]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(first, len(ids))
    raw = [key[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    owners = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(owner, pa.int64()))
    return pa.table({"id": ids[first], "hash": hashes[first], "bucket": pa.array(np.full(len(first), bucket), pa.int32()), "keys": pa.array(raw, pa.binary()), "owners": owners})


_REGION = "owner long, id long, hash long, start int, words binary"


def _regions(least: int, n_buckets: int):
    """Cuts the parts of each text that could match, by owner."""
    k = max(1, least // 2)

    def run(batches):
        for batch in batches:
            for part, buf, off in texts.chunks(batch, "text"):
                words = texts.Words(buf, off)
                w = words.hashed()
                at, h = _fingerprints(w, words.first, least)
                if not len(at):
                    continue
                row = np.searchsorted(words.first, at, "right") - 1
                mine = texts.mix(((h % U64(n_buckets)) << U64(32)) | (h >> U64(32))) ^ texts.mix(row.astype(U64) + U64(1))
                want, owner = [], []
                for r, shared in enumerate(part.column(3).to_pylist()):
                    for one in shared:
                        short = np.frombuffer(one["keys"], np.uint32).astype(U64)
                        want.append(texts.mix((U64(one["bucket"]) << U64(32)) | short) ^ texts.mix(np.full(1, r + 1, U64)))
                        owner.append(np.asarray(one["owners"], np.int64))
                want, owner = np.concatenate(want), np.concatenate(owner)
                order = np.argsort(want)
                want, owner = want[order], owner[order]
                i = np.minimum(np.searchsorted(want, mine), len(want) - 1)
                hit = want[i] == mine
                at, row, owner = at[hit], row[hit], owner[i[hit]]
                order = np.lexsort((at, owner, row))
                at, row, owner = at[order], row[order], owner[order]
                lo = np.maximum(at - (least - k), words.first[row])
                hi = np.minimum(at + least, words.first[row + 1])
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (lo[1:] > hi[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                lo, hi = lo[first], hi[np.append(first[1:], len(at)) - 1]
                row, owner = row[first], owner[first]
                size = hi - lo
                offsets = np.concatenate(([0], np.cumsum(size))) * 8
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(w[texts.ranges(lo, size)])]).cast(pa.binary())
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids), pa.array(hashes), pa.array((lo - words.first[row]).astype(np.int32)), raw], ["owner", "id", "hash", "start", "words"])

    return jobs.tidy(run)


def _stream_shard(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, regions: list[bytes], least: int) -> list[tuple[int, int, int, int]]:
    """(id, hash, first word, word after the last) of all spans found; rows sorted by id."""
    if len(ids) < 2 or ids[0] == ids[-1]:
        return []
    automaton, seen, found = SuffixAutomaton(), set(), []
    code: dict[int, int] = {}
    edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))).tolist()
    last = edges[-2]
    for a, b in zip(edges[:-1], edges[1:]):
        adding, mine = [], []
        for r in range(a, b):
            raw = regions[r]
            n = len(raw) // 8
            if n < least:
                continue
            if raw in seen:
                found.append((int(ids[r]), int(hashes[r]), int(starts[r]), int(starts[r]) + n))
                continue
            mine.append(raw)
            sequence = [code.setdefault(x, len(code)) for x in np.frombuffer(raw, np.int64).tolist()]
            runs = automaton.matches(sequence, least) if a else []
            at = least - 1
            for x, y in runs:
                found.append((int(ids[r]), int(hashes[r]), int(starts[r]) + x - least + 1, int(starts[r]) + y))
                if x > at:
                    adding.append(sequence[at - least + 1 : x])
                at = y
            if at < n:
                adding.append(sequence[at - least + 1 :])
        if a == last:
            break
        seen.update(mine)
        for sequence in adding:
            automaton.add(sequence)
    return found


def _stream(least: int):
    """Spans of all shards of a partition; rows come sorted by shard, id, start."""

    def run(batches):
        pend, size = None, 0

        def work(table):
            o, ids, hashes, starts = (table.column(c).to_numpy() for c in ("owner", "id", "hash", "start"))
            regions = table.column("words").to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1], [True]))).tolist()
            found = []
            for a, b in zip(edge[:-1], edge[1:]):
                found += _stream_shard(ids[a:b], hashes[a:b], starts[a:b], regions[a:b], least)
            if found:
                cols = list(zip(*found))
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["id", "hash", "first", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            pend = table if pend is None else pa.concat_tables([pend, table])
            size += batch.nbytes
            if size < 32 << 20:
                continue
            pend = pend.combine_chunks()
            o = pend.column("owner").to_numpy()
            other = np.flatnonzero(o != o[-1])
            if len(other):
                got = work(pend.slice(0, int(other[-1]) + 1))
                if got is not None:
                    yield got
                pend = pend.slice(int(other[-1]) + 1)
            size = pend.nbytes
        if pend is not None:
            got = work(pend.combine_chunks())
            if got is not None:
                yield got

    return jobs.tidy(run)


def _windows(least: int):
    """Hashes of all windows of the regions."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [x.as_py() for x in part.column(3)]
                size = np.array([len(x) // 8 for x in raw])
                words = np.frombuffer(b"".join(raw), U64)
                count = np.maximum(size - least + 1, 0)
                at = texts.ranges(np.cumsum(size) - size, count)
                row = np.repeat(np.arange(len(size)), count)
                ids, hashes, start = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in range(3))
                first = start + texts.ranges(np.zeros(len(size), np.int64), count)
                yield pa.RecordBatch.from_arrays([pa.array(texts.range_hash(words, at, at + least).view(np.int64)), pa.array(ids), pa.array(hashes), pa.array(first.astype(np.int32))], ["window", "id", "hash", "first"])

    return jobs.tidy(run)


def _spans(base: DataFrame, least: int, shard_rows: int) -> DataFrame:
    """(id, hash, spans: struct of first and last, which is excluded), not merged."""
    spark = base.sparkSession
    count = jobs.buckets(spark)
    keyed = base.select("id", "hash", "text")
    owned = keyed.mapInArrow(_emit(least, count), "bucket int, keys binary, ids binary, hashes binary, counts binary").groupBy("bucket").applyInArrow(jobs.tidy_group(_owned), _OWNED)
    owned = jobs.saved(owned, "owned")
    shared = owned.groupBy("id", "hash").agg(F.collect_list(F.struct("bucket", "keys", "owners")).alias("shared"))
    wide = owned.select("id", F.explode(F.array_distinct("owners")).alias("owner")).distinct().groupBy("owner").count()
    wide = jobs.saved(wide.where(F.col("count") > shard_rows).select("owner", F.lit(True).alias("wide")), "wide")
    regions = keyed.join(shared, ["id", "hash"]).select("id", "hash", "text", "shared").mapInArrow(_regions(least, count), _REGION)
    regions = jobs.saved(regions.join(wide, "owner", "left"), "regions")
    narrow = regions.where("wide is null").repartition("owner").sortWithinPartitions("owner", "id", "start")
    found = narrow.select("owner", "id", "hash", "start", "words").mapInArrow(_stream(least), "id long, hash long, first int, last int")
    windows = regions.where("wide").select("id", "hash", "start", "words").mapInArrow(_windows(least), "window long, id long, hash long, first int")
    lowest = windows.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("window", "low")
    again = windows.join(lowest, "window").where("id > low").select("id", "hash", "first", (F.col("first") + least).alias("last"))
    return found.union(again).groupBy("id", "hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _remove(text_at: int, length_at: int, n_cols: int):
    def run(batches):
        for batch in batches:
            for part, buf, off in texts.chunks(batch, batch.schema.names[text_at]):
                arrays = part.columns[:n_cols]
                spans = part.column(n_cols)
                removed = np.zeros(len(part), np.int64)
                if spans.null_count < len(part):
                    words = texts.Words(buf, off)
                    size = np.diff(words.first)
                    lists = spans.fill_null([]) if spans.null_count else spans
                    each = lists.value_lengths().to_numpy(zero_copy_only=False)
                    flat = lists.flatten()
                    first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                    row = np.repeat(np.arange(len(part)), each)
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, words.first[row] + np.minimum(first, size[row]), 1)
                    np.add.at(mark, words.first[row] + np.minimum(last, size[row]), -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    total = np.concatenate(([0], np.cumsum(gone)))
                    removed = total[words.first[1:]] - total[words.first[:-1]]
                    # a word goes with what follows it, up to the next word or the end of the text
                    row = words.row()[gone]
                    begin = words.start[gone]
                    follow = np.append(words.start[1:], len(buf))[gone]
                    ends = np.minimum(follow, off[row + 1])
                    keep = np.zeros(len(buf) + 1, np.int64)
                    np.add.at(keep, begin, 1)
                    np.add.at(keep, ends, -1)
                    keep = np.cumsum(keep)[:-1] == 0
                    upto = np.concatenate(([0], np.cumsum(keep)))
                    text = texts.string_array(buf[keep], upto[off])
                    touched = pa.array(removed > 0)
                    arrays = list(arrays)
                    if length_at >= 0:
                        arrays[length_at] = pa.compute.if_else(touched, pa.compute.utf8_length(text).cast(arrays[length_at].type), arrays[length_at])
                    arrays[text_at] = pa.compute.if_else(touched, text, arrays[text_at].cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed)], [f"c{i}" for i in range(n_cols + 1)])

    return jobs.tidy(run)


def substring_dedup(docs: DataFrame, min_words: int = 50, shard_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", removed_col: str = "removed_words") -> DataFrame:
    """The rows with repeated spans of min_words words or more removed from the text.

    Words are those of `texts`; a word goes together with the separators that
    follow it. Of equal spans the one in the document of the lowest id stays.
    All columns stay; `chars_col`, if there is such an integer column, is set to
    the new length in characters where the text changed; `removed_col` counts
    the words removed and replaces a column of that name.

    Rows of equal ids count as one document and don't shorten one another. A
    text may become empty; its row stays. Rows with NULL id or NULL text stay as
    they are, with 0 words removed. Texts of fewer than min_words words, or
    without words, stay as they are. No documents: no rows.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    names = docs.columns
    keep = [i for i, c in enumerate(names) if c != removed_col]
    base = jobs.picked(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    base = base.where("id is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    spans = _spans(base, min_words, shard_rows).select(F.col("id").alias("s_id"), F.col("hash").alias("s_hash"), "spans")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in keep])
    own_id, own_text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    joined = plain.join(spans, (F.col(own_id).cast("long") == F.col("s_id")) & (F.xxhash64(F.col(own_text).cast("string")) == F.col("s_hash")), "left").drop("s_id", "s_hash")
    kept = [names[i] for i in keep]
    chars = kept.index(chars_col) if chars_col in kept and isinstance(docs.schema[names.index(chars_col)].dataType, (T.IntegerType, T.LongType)) else -1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType() if c == text_col and k == names.index(text_col) else docs.schema[k].dataType) for i, (k, c) in enumerate(zip(keep, kept))] + [T.StructField(f"c{len(kept)}", T.LongType())])
    out = joined.mapInArrow(_remove(kept.index(text_col), chars, len(kept)), schema)
    return out.toDF(*kept, removed_col)
