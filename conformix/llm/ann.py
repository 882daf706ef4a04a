"""Approximate nearest neighbours with balanced posting lists.

1. Balanced k-means over a sample of at most `sample_rows` vectors makes the lists:
   each round, distances are charged for a list's size, lists of more than 1.5
   times the aim are split and those of less than a fifth are dropped. There are
   `sample_rows / 32` lists at most, so what goes to the tasks is bounded.
2. Every vector is posted to its nearest list and, near a boundary, also to others
   whose centroid is at most (1 + closure) times as far, up to `replicas`; a
   centroid is skipped if one chosen before is nearer to it than the vector is.
3. Centroids are searched in memory by best-first walks over their neighbour
   graph. A query probes the lists whose centroids are at most (1 + probe) times
   as far as the nearest one (or as vectors usually are from their centroid). The
   ratio alone decides: walks are widened until they reach beyond it.
4. A list of more than `block_rows` vectors is spread over blocks. Queries meet
   blocks in one shuffle; a block of many lists' worth of vectors makes, inside
   its task, lists of its own in the same way, which are pruned by the same ratio.
   So work per query follows what the ratio selects, whatever a list's size.

Equal vectors are posted once, with the k + 1 lowest ids that have them: no answer
can have more of them, so a group of copies costs as much as one vector.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jobs

_SLAB = 4096


class Lists(NamedTuple):
    """Centroids, their neighbour graph, the nodes where walks start, the usual distance of a vector from its centroid, and vectors by list."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    radius: float = 0.0
    sizes: np.ndarray | None = None


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def build_graph(centroids: np.ndarray, degree: int = 16, candidates: int = 64, links: int = 12) -> Lists:
    """Neighbour graph: of the nearest `candidates` those that aren't nearer to one taken
    before than to the node, up to `degree`, and a few random links; deterministic."""
    m = len(centroids)
    wide = min(candidates, max(m - 1, 0))
    rng = np.random.RandomState(7)
    graph = np.empty((m, min(degree, wide) + min(links, m)), np.int64)
    for lo in range(0, m, 1024):
        d = _square_distances(centroids[lo : lo + 1024], centroids)
        every = np.arange(len(d))
        d[every, every + lo] = np.inf
        near = np.argpartition(d, wide - 1, 1)[:, :wide] if 0 < wide < m else np.argsort(d, 1)[:, :wide]
        dist = np.take_along_axis(d, near, 1)
        rank = np.argsort(dist, 1, kind="stable")
        near, dist = np.take_along_axis(near, rank, 1), np.take_along_axis(dist, rank, 1)
        apart = np.zeros(near.shape, bool)
        for j in range(wide):
            between = ((centroids[near[:, :j]] - centroids[near[:, j]][:, None]) ** 2).sum(2)
            apart[:, j] = ~(apart[:, :j] & (between < dist[:, j : j + 1])).any(1)
        first = np.argsort(~apart, 1, kind="stable")[:, : min(degree, wide)]  # then the nearest of the others
        graph[lo : lo + 1024, : first.shape[1]] = np.take_along_axis(near, first, 1)
    graph[:, graph.shape[1] - min(links, m) :] = rng.randint(0, m, (m, min(links, m)))
    return Lists(centroids, graph, rng.permutation(m)[: min(m, 64)])


def search_graph(q: np.ndarray, lists: Lists, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `beam` nearest centroids found, nearest first: numbers and distances.

    All queries walk at once; each step expands every query's nearest node that
    isn't expanded yet, until no query has one in its beam. Places that no node
    was found for have number -1 and infinite distance.
    """
    c, graph, entries = lists[:3]
    n = len(q)
    norms = (c * c).sum(1)
    own = (q * q).sum(1)

    def to(ids, rows):
        return np.maximum(own[rows][:, None] + norms[ids] - 2 * np.einsum("nd,nkd->nk", q[rows], c[ids]), 0)

    every = np.arange(n)
    ids = np.tile(entries, (n, 1))
    dist = to(ids, every)
    rank = np.argsort(dist, 1, kind="stable")[:, :beam]
    ids, dist = np.take_along_axis(ids, rank, 1), np.take_along_axis(dist, rank, 1)
    if ids.shape[1] < beam:
        pad = beam - ids.shape[1]
        ids, dist = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
    done = ids < 0
    while True:
        rows = np.flatnonzero(~done.all(1))
        if not len(rows):
            return ids, np.sqrt(dist)
        best = np.where(done[rows], np.inf, dist[rows]).argmin(1)
        done[rows, best] = True
        new = graph[ids[rows, best]]
        all_ids = np.concatenate([ids[rows], new], 1)
        all_d = np.concatenate([dist[rows], to(new, rows)], 1)
        all_done = np.concatenate([done[rows], np.zeros(new.shape, bool)], 1)
        # of equal nodes the first, already known one stays
        order = np.argsort(all_ids, 1, kind="stable")
        sorted_ids = np.take_along_axis(all_ids, order, 1)
        again = np.zeros(sorted_ids.shape, bool)
        again[:, 1:] = (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0)
        drop = np.zeros_like(again)
        np.put_along_axis(drop, order, again, 1)
        all_d = np.where(drop, np.inf, all_d)
        all_ids = np.where(drop, -1, all_ids)
        all_done |= drop
        rank = np.argsort(all_d, 1, kind="stable")[:, :beam]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(x, rank, 1) for x in (all_ids, all_d, all_done))


def fit_lists(x: np.ndarray, m: int, rounds: int = 8) -> Lists:
    """About m balanced lists for the vectors x, which must come in no particular order."""
    m = max(1, min(m, len(x)))
    aim = len(x) / m
    c, charge = x[:m].copy(), np.zeros(m, np.float32)
    square = (x * x).sum(1)
    for r in range(rounds):
        pick, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        for lo in range(0, len(x), _SLAB):
            cost = _square_distances(x[lo : lo + _SLAB], c) + charge
            pick[lo : lo + _SLAB] = at = cost.argmin(1)
            far[lo : lo + _SLAB] = cost[np.arange(len(at)), at] - charge[at]
        order = np.argsort(pick, kind="stable")
        some, start, size = np.unique(pick[order], return_index=True, return_counts=True)
        mean = np.add.reduceat(x[order].astype(np.float64), start, 0) / size[:, None]
        if r == rounds - 1:
            keep = size >= min(0.2 * aim, size.max())
            return build_graph(mean[keep].astype(np.float32))._replace(radius=float(np.sqrt(far.mean(dtype=np.float64))), sizes=size[keep])
        spread = np.sqrt(np.maximum(np.add.reduceat(x[order].astype(np.float64) ** 2, start, 0) / size[:, None] - mean**2, 0))
        new, sizes = [], []
        for s, a, dev in zip(size, mean, spread):
            if s > 1.5 * aim and dev.max() > 0:
                step = np.zeros_like(dev)
                step[dev.argmax()] = dev.max()
                new += [a + step, a - step]
                sizes += [s / 2, s / 2]
            elif s >= 0.2 * aim or len(size) == 1:
                new.append(a)
                sizes.append(s)
        # splits make no more lists than twice the aim
        c, sizes = np.array(new, np.float32)[: 2 * m], np.array(sizes)[: 2 * m]
        charge = ((spread**2).sum(1).mean() * 0.1 * (sizes / aim - 1)).astype(np.float32)
    raise ValueError("rounds must be 1 at least")


def within_ratio(q: np.ndarray, lists: Lists, probe: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) numbers for all lists that the distance ratio selects."""
    m, rows, beam, found = len(lists.centroids), np.arange(len(q)), 16, []
    while len(rows):
        beam = min(beam, m)
        wider = []
        for lo in range(0, len(rows), 1024):
            own = rows[lo : lo + 1024]
            near, dist = search_graph(q[own], lists, beam)
            hit = (near >= 0) & (dist <= (1 + probe) * np.maximum(dist[:, :1], lists.radius))
            more = hit[:, -1] & (beam < m)
            r, j = np.nonzero(hit & ~more[:, None])
            found.append((own[r], near[r, j]))
            wider.append(own[more])
        rows, beam = np.concatenate(wider), 2 * beam
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def closures(x: np.ndarray, lists: Lists, closure: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) numbers: each vector's nearest list and those across a near boundary."""
    found = []
    for lo in range(0, len(x), 2048):
        part = x[lo : lo + 2048]
        near, dist = search_graph(part, lists, min(2 * replicas, len(lists.centroids)))
        take = np.zeros(near.shape, bool)
        take[:, 0] = True
        count = np.ones(len(part), np.int64)
        for j in range(1, near.shape[1]):
            ok = (near[:, j] >= 0) & (dist[:, j] <= (1 + closure) * dist[:, 0]) & (count < replicas)
            for i in range(j):
                rows = np.flatnonzero(ok & take[:, i])
                if len(rows):
                    apart = np.sqrt(((lists.centroids[near[rows, i]] - lists.centroids[near[rows, j]]) ** 2).sum(1))
                    ok[rows[apart < dist[rows, j]]] = False
            take[:, j] = ok
            count += ok
        r, j = np.nonzero(take)
        found.append((r + lo, near[r, j]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _nearest(q: np.ndarray, v: np.ndarray, low: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `take` nearest of v for each query, of equal ones those of the lowest id `low`: query, vector, distance to 6 places."""
    rows, cols, far = [], [], []
    for lo in range(0, len(q), 512):
        part = q[lo : lo + 512]
        d = _square_distances(part, v)
        if take < len(v):
            edge = np.sqrt(np.partition(d, take - 1, 1)[:, take - 1]) + 2e-3  # beyond what rounding of squares can swap
            r, j = np.nonzero(d <= (edge**2)[:, None])
        else:
            r, j = np.nonzero(d >= 0)
        exact = np.round(np.sqrt(((part[r].astype(np.float64) - v[j]) ** 2).sum(1)), 6)
        order = np.lexsort((low[j], exact, r))
        r, j, exact = r[order], j[order], exact[order]
        first = np.searchsorted(r, np.arange(len(part)))
        keep = np.arange(len(r)) - first[r] < take
        rows.append(r[keep] + lo)
        cols.append(j[keep])
        far.append(exact[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(far)


def _search(q: np.ndarray, v: np.ndarray, low: np.ndarray, take: int, list_rows: int, closure: float, replicas: int, probe: float):
    """_nearest, by lists of the block's own where it holds several lists' worth of vectors."""
    if len(v) <= 4 * list_rows:
        return _nearest(q, v, low, take)
    order = np.random.RandomState(11).permutation(len(v))
    m = -(-len(v) // list_rows)
    lists = fit_lists(v[order[: 32 * m]], m)
    row, own = closures(v, lists, closure, replicas)
    ask, at = within_ratio(q, lists, probe)
    row, own = row[np.argsort(own, kind="stable")], np.sort(own)
    ask, at = ask[np.argsort(at, kind="stable")], np.sort(at)
    found = []
    for x in np.unique(at):
        rows, asked = row[slice(*np.searchsorted(own, [x, x + 1]))], ask[slice(*np.searchsorted(at, [x, x + 1]))]
        if len(rows):
            r, j, far = _nearest(q[asked], v[rows], low[rows], take)
            found.append((asked[r], rows[j], far))
    r, j, far = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((j, low[j], far, r))
    r, j, far = r[order], j[order], far[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (j[1:] != j[:-1])))[: len(r)]
    r, j, far = r[new], j[new], far[new]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q)))[r] < take
    return r[keep], j[keep], far[keep]


def _fit(n: int, list_rows: int, sample_rows: int):
    def run(batches):
        parts = [_vectors(b.column(0)) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            lists = fit_lists(x, min(-(-n // list_rows), max(1, sample_rows // 32)))
            yield pa.RecordBatch.from_arrays([pa.array([lists.centroids.tobytes()], pa.binary()), pa.array([lists.sizes.astype(np.float64) / len(x)], pa.list_(pa.float64())), pa.array([lists.radius])], ["centroids", "shares", "radius"])

    return jobs.tidy(run)


def build_lists(base: DataFrame, n: int, list_rows: int, sample_rows: int) -> Lists:
    """Balanced lists for the n vectors of the column v, fitted to those of the lowest ids' hashes."""
    share = min(1.0, sample_rows / n)
    sample = base.where(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)) if share < 1 else base
    one = sample.select("v", F.xxhash64(F.col("ids")[0]).alias("h")).repartition(1).sortWithinPartitions("h").select("v")
    row = one.mapInArrow(_fit(n, list_rows, sample_rows), "centroids binary, shares array<double>, radius double").first()
    c = np.frombuffer(row["centroids"], np.float32)
    return build_graph(c.reshape(len(row["shares"]), -1))._replace(radius=row["radius"], sizes=np.array(row["shares"]) * n)


def _post(lists: Lists, blocks: np.ndarray, closure: float, replicas: int):
    def run(batches):
        for batch in batches:
            v = _vectors(batch.column(1))
            low = batch.column(2).to_numpy(zero_copy_only=False)
            row, own = closures(v, lists, closure, replicas)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array((low[row] % blocks[own]).astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["list", "block", "ids", "v"])

    return jobs.tidy(run)


def _ask(lists: Lists, blocks: np.ndarray, probe: float):
    def run(batches):
        for batch in batches:
            row, own = within_ratio(_vectors(batch.column(1)), lists, probe)
            each = np.repeat(np.arange(len(row)), blocks[own])
            block = np.arange(len(each)) - np.repeat(np.cumsum(blocks[own]) - blocks[own], blocks[own])
            at = pa.array(row[each])
            yield pa.RecordBatch.from_arrays([pa.array(own[each].astype(np.int32)), pa.array(block.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["list", "block", "key", "v"])

    return jobs.tidy(run)


_FOUND = "key long, distance double, ids array<long>"


def _compare(take: int, list_rows: int, closure: float, replicas: int, probe: float):
    def run(key, left, right):
        if not len(left) or not len(right):
            return pa.table({"key": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        ids = right.column("ids").combine_chunks()
        low = ids.flatten().to_numpy(zero_copy_only=False)[np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))))[:-1]]
        r, j, far = _search(_vectors(left.column("v")), _vectors(right.column("v")), low, take, list_rows, closure, replicas, probe)
        return pa.table({"key": left.column("key").combine_chunks().take(pa.array(r)), "distance": pa.array(far), "ids": ids.take(pa.array(j))})

    return jobs.tidy_cogroup(run)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    base = jobs.picked(df, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
    return base.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))").withColumn("h", F.xxhash64("v"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, list_rows: int = 512, sample_rows: int = 1 << 18, block_rows: int = 1 << 16, closure: float = 0.1, replicas: int = 4, probe: float = 0.15, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query, the k nearest of the vectors by Euclidean distance, approximately.

    Queries are rows of the same form; one that is itself among the vectors, by its
    id, isn't its own neighbour. Returns the query's id and `neighbours`, an array
    of (id, distance) ordered by distance, rounded to 6 places, and id. All vectors
    are indexed; only the lists are fitted to a sample of `sample_rows` of them.

    Rows with NULL id, with a vector that is NULL or empty, holds NULL or NaN, or
    isn't of the commonest length are left out. Rows that repeat an id are one
    vector, that of the lowest hash. Equal vectors are neighbours at distance 0.
    Fewer than k others: as many as there are; none: an empty array. No queries:
    no rows. Other columns are ignored.
    """
    base = _valid(vectors, id_col, vector_col)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    form = F.expr("cast(array() as array<struct<id:bigint,distance:double>>)")
    if not sizes:
        return base.select(F.col("id").alias(id_col), form.alias("neighbours")).limit(0)
    one = lambda df: df.where(F.size("v") == sizes[0]["d"]).groupBy("id").agg(F.min_by(F.struct("h", "v"), F.struct("h", "v")).alias("x")).select("id", "x.h", "x.v")
    # of each group of equal vectors the k + 1 lowest ids: they are cut before the shuffle
    lowest = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    reps = one(base).withColumn("r", lowest).where(F.col("r") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "v")
    reps = jobs.saved(reps, "vectors")
    lists = build_lists(reps, reps.count(), list_rows, sample_rows)
    blocks = np.maximum(1, np.ceil(lists.sizes * replicas / block_rows)).astype(np.int64)
    asked = one(_valid(queries, id_col, vector_col))
    asked = jobs.saved(asked.join(asked.groupBy("h", "v").agg(F.min("id").alias("key")), ["h", "v"]).select("id", "key", "v"), "queries")
    keyed = asked.where("id = key").select("key", "v").mapInArrow(_ask(lists, blocks, probe), "list int, block int, key long, v array<float>")
    posted = reps.select("ids", "v", F.col("ids")[0].alias("low")).mapInArrow(_post(lists, blocks, closure, replicas), "list int, block int, ids array<long>, v array<float>")
    found = keyed.groupBy("list", "block").cogroup(posted.groupBy("list", "block")).applyInArrow(_compare(k + 1, list_rows, closure, replicas, probe), _FOUND)
    flat = F.flatten(F.transform("c", lambda c: F.transform(c["ids"], lambda i: F.struct(c["distance"].alias("distance"), i.alias("id")))))
    best = found.groupBy("key").agg(F.collect_set(F.struct("distance", "ids")).alias("c")).select("key", F.slice(F.sort_array(flat), 1, k + 1).alias("best"))
    out = asked.select("id", "key").join(best, "key", "left")
    near = F.transform(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k), lambda x: F.struct(x["id"].alias("id"), x["distance"].alias("distance")))
    return out.select(F.col("id").alias(id_col), F.coalesce(near, form).alias("neighbours"))
