"""Packing of documents into windows of fixed size, in order.

The tokens of consecutive documents form one sequence per shard. Windows may end
at the end of a document or of a sentence, and after any word of a sentence that is
longer than a window; where they do is chosen by dynamic programming, so that the
sum over windows of

    pad_cost * (window - length)   if the window isn't full
    trunc_cost * (length - window) if it overflows and its tail is dropped
    cut_cost                       if it ends within a document

is least. Both kinds of transition are minima over a prefix or a sliding range of
earlier cuts, kept in a running minimum and a monotone queue, so a shard costs
time linear in its sentences.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jobs, texts

SCHEMA = "shard long, window_no int, n_tokens long, n_padding long, n_truncated long, pieces array<struct<doc_id:long,start:int,end:int>>, text string"
_BREAK = np.zeros(256, bool)
_BREAK[[10, 33, 46, 63]] = True


def choose_cuts(ends: list[int], is_doc_end: list[bool], window: int, pad_cost: float, trunc_cost: float, cut_cost: float) -> tuple[list[int], float]:
    """Cuts of least cost: indices into `ends` (tokens up to the end of each unit), and the cost.

    Of equal costs, the window that starts earliest wins, and one that fits
    wins over one that overflows.
    """
    n = len(ends)
    bound = [0, *ends]
    best = [0.0] * (n + 1)
    came = [0] * (n + 1)
    queue: deque[int] = deque()
    fits = [0.0] * (n + 1)
    over, over_at, left = float("inf"), -1, 0
    for j in range(1, n + 1):
        i = j - 1
        value = fits[i] = best[i] + pad_cost * bound[i]
        while queue and fits[queue[-1]] > value:
            queue.pop()
        queue.append(i)
        b = bound[j]
        least = b - window
        while left < j and bound[left] < least:
            value = best[left] - trunc_cost * bound[left]
            if value < over:
                over, over_at = value, left
            left += 1
        while queue and queue[0] < left:
            queue.popleft()
        cost, at = float("inf"), -1
        if queue:
            at = queue[0]
            cost = fits[at] + pad_cost * (window - b)
        if over_at >= 0:
            other = over + trunc_cost * (b - window)
            if other < cost:
                cost, at = other, over_at
        best[j] = cost if is_doc_end[i] else cost + cut_cost
        came[j] = at
    cuts = []
    j = n
    while j > 0:
        cuts.append(j - 1)
        j = came[j]
    return cuts[::-1], best[n]


def _pack(window: int, pad_cost: float, trunc_cost: float, cut_cost: float):
    def run(key, table):
        table = table.take(pc.sort_indices(table, [("id", "ascending"), ("h", "ascending"), ("text", "ascending")], null_placement="at_start")).combine_chunks()
        ids = table.column("id").to_pylist()
        text = table.column("text").combine_chunks()
        buf, off = texts.text_buffer(text)
        words = texts.Words(buf, off)
        count = np.diff(words.first)
        # a unit ends after the last word of a document, or after a word with a sentence break behind it
        breaks = np.concatenate(([0], np.cumsum(_BREAK[buf]))) if len(buf) else np.zeros(1, np.int64)
        after = np.append(words.start[1:], len(buf))
        stops = (breaks[after] > breaks[words.end]) if len(words) else np.zeros(0, bool)
        stops[words.first[1:][count > 0] - 1] = True
        unit_end = np.flatnonzero(stops) + 1
        # one longer than the window may be cut after any of its words
        size = np.diff(unit_end, prepend=0)
        stops[texts.ranges((unit_end - size)[size > window], size[size > window])] = True
        unit_end = np.flatnonzero(stops) + 1
        unit_row = np.searchsorted(words.first, unit_end - 1, "right") - 1
        empty = np.flatnonzero(count == 0)
        unit_end, unit_row = np.concatenate([unit_end, words.first[empty]]), np.concatenate([unit_row, empty])
        order = np.argsort(unit_row, kind="stable")
        unit_end, unit_row = unit_end[order], unit_row[order]
        doc_end = np.append(unit_row[1:] != unit_row[:-1], True)
        cuts, _ = choose_cuts(unit_end.tolist(), doc_end.tolist(), window, pad_cost, trunc_cost, cut_cost)
        chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80))) if len(buf) else np.zeros(1, np.int64)
        # a unit's bytes: from the end of the one before, or the start of its document
        last_byte = np.where(doc_end, off[unit_row + 1], np.append(words.start, len(buf))[np.minimum(unit_end, len(words))])
        rows, u, used = [], 0, 0
        raw = buf.tobytes()
        for number, c in enumerate(cuts):
            total = int(unit_end[c]) - used
            kept = min(total, window)
            cap = int(words.end[used + window - 1]) if total > window else None
            pieces, parts = [], []
            while u <= c:
                row = int(unit_row[u])
                v = min(int(np.searchsorted(unit_row, row, "right")) - 1, c)
                begin = int(off[row]) if u == 0 or unit_row[u - 1] != row else int(last_byte[u - 1])
                end = int(last_byte[v])
                if cap is not None:
                    end = min(end, cap)
                if cap is None or begin < cap:
                    base = int(chars[off[row]])
                    pieces.append({"doc_id": ids[row], "start": int(chars[begin]) - base, "end": int(chars[end]) - base})
                    parts.append(raw[begin:end].decode("utf-8", "replace"))
                u = v + 1
            rows.append((key[0].as_py(), number, kept, window - kept, total - kept, pieces, "\n\n".join(parts)))
            used = int(unit_end[c])
        cols = list(zip(*rows))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["shard", "window_no", "n_tokens", "n_padding", "n_truncated", "pieces", "text"])

    return jobs.tidy_group(run)


#: What a document counts towards its shard besides its bytes.
_ROW_BYTES = 64
#: Starts of shards that are sent to the tasks (16 bytes each); if there are more, they are joined.
_MOST_STARTS = 1 << 18


def _ordinal(id_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Strings of 16 bytes that sort as (id, h) do."""
    wide = np.stack([id_, h], 1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(wide.astype(">u8")).view("S16").ravel()


def _placed(starts: np.ndarray):
    """Number of the range that (id, h) falls in; rows that begin several ranges are spread over them by their number."""

    @F.pandas_udf(T.LongType())
    def place(id_: pd.Series, h: pd.Series, row: pd.Series) -> pd.Series:
        key = _ordinal(id_.to_numpy(), h.to_numpy())
        lo, hi = np.searchsorted(starts, key, "left"), np.searchsorted(starts, key, "right")
        wide = np.maximum(hi - lo, 1)
        return pd.Series(np.maximum(hi - 1 - row.to_numpy() % wide, 0))

    return place


def _sharded(base: DataFrame, shard_bytes: int) -> DataFrame:
    """base (id, text, h) with `shard`: documents in the order of id, then h, cut where their bytes pass a multiple of shard_bytes.

    Only ids, hashes and sizes are sorted, in ranges that a sample divides; the
    ranges' totals are added up by the driver. So shards depend on the order of
    documents alone, not on the values of ids or on partitions.
    """
    key = F.coalesce("id", F.lit(-(1 << 63))).alias("o")
    sizes = jobs.saved(base.select(key, "h", (F.octet_length("text") + _ROW_BYTES).alias("n"), F.monotonically_increasing_id().alias("row")), "sizes")
    n = sizes.count()
    parts = min(max(1, n >> 18), 1 << 14)
    sample = sizes.orderBy(F.xxhash64("o", "h")).limit(8 * parts).select("o", "h").toPandas()
    edges = np.sort(_ordinal(sample["o"].to_numpy(), sample["h"].to_numpy()))[:: max(1, len(sample) // parts)]
    ranged = sizes.withColumn("range", _placed(edges)("o", "h", "row"))
    before, at = {}, 0
    for r in sorted(ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        before[r["range"]] = at
        at += r["n"]
    table = base.sparkSession.createDataFrame(list(before.items()), "range long, before long")
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("o", "h", "row").rowsBetween(Window.unboundedPreceding, -1))
    offset = F.coalesce(inside, F.lit(0)) + F.col("before")
    placed = jobs.saved(ranged.join(table, "range").select("o", "h", F.floor(offset / F.lit(shard_bytes)).cast("long").alias("shard")), "shards")
    jobs.discard(sizes)
    row = F.monotonically_increasing_id()
    begins = placed.groupBy("shard").agg(F.min(F.struct("o", "h")).alias("first"))
    if at // shard_bytes < _MOST_STARTS:
        starts = begins.select("first.o", "first.h").toPandas()
        starts = np.sort(_ordinal(starts["o"].to_numpy(), starts["h"].to_numpy()))
        return base.withColumn("shard", _placed(starts)(key, F.col("h"), row))
    # rows of one key that fill several shards are spread over those that they begin, as above
    spread = placed.groupBy("o", "h").agg(F.min("shard").alias("lo")).join(begins.groupBy("first.o", "first.h").agg(F.min("shard").alias("from"), F.count("*").alias("wide")), ["o", "h"], "left")
    spread = spread.select("o", "h", F.coalesce("from", "lo").alias("lo"), F.coalesce("wide", F.lit(1)).alias("wide"))
    joined = base.withColumn("o", key).withColumn("row", row).join(spread, ["o", "h"])
    return joined.select(*base.columns, (F.col("lo") + F.col("wide") - 1 - F.pmod("row", "wide")).alias("shard"))


def pack(docs: DataFrame, window: int = 2048, shard_bytes: int = 4 << 20, pad_cost: float = 1.0, trunc_cost: float = 4.0, cut_cost: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of at most `window` words, in the order of document ids.

    Returns shard, window_no, n_tokens kept, n_padding, n_truncated, pieces (the
    documents in the window with the range of characters taken from each) and
    their text, documents separated by a blank line.

    Words are those of `texts`; a sentence ends where a full stop, question or
    exclamation mark or a line break follows a word. Documents in the order of
    their ids are cut into shards of about `shard_bytes` of text, which are packed
    in parallel; one window of a shard is cut short. Only the order of ids matters.

    Rows without id come first. Rows that repeat an id are ordered by a hash of
    their text and all packed; of rows that repeat id and text, any that fill more
    than one shard are spread evenly. NULL and empty texts have a piece of length
    0. Longer documents are cut at sentences, and a sentence longer than the
    window at words. Words are dropped, and counted, only where that costs less
    than to pad or to cut. Ties: see choose_cuts. Other columns are ignored. No documents: no windows.
    """
    if window < 1 or shard_bytes < 1 or min(pad_cost, trunc_cost, cut_cost) < 0:
        raise ValueError("window and shard_bytes must be positive, costs not negative")
    base = jobs.picked(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = _sharded(base.withColumn("h", F.xxhash64("text")), shard_bytes)
    return base.groupBy("shard").applyInArrow(_pack(window, pad_cost, trunc_cost, cut_cost), SCHEMA)
