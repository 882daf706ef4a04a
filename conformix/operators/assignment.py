"""Optimal one-to-one assignment by shortest augmenting paths."""

from __future__ import annotations

import numpy as np


def best_assignment(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matching of min(n, m) pairs with the greatest total score.

    Rows come in ascending order. Where several matchings are optimal, the one
    found by taking rows in order and, among equal columns, the lowest is
    returned, so the result is deterministic.
    """
    score = np.asarray(score, np.float64)
    n, m = score.shape
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > m:
        cols, rows = best_assignment(score.T)
        order = np.argsort(rows, kind="stable")
        return rows[order], cols[order]
    cost = score.max() - score
    u = cost.min(1)
    v = np.zeros(m)
    col_of, row_of = np.full(n, -1), np.full(m, -1)
    # rows whose cheapest column is free take it: reduced costs stay non-negative
    free = np.ones(m, bool)
    left = []
    for i in range(n):
        tight = np.flatnonzero(free & (cost[i] <= u[i]))
        if len(tight):
            j = tight[0]
            col_of[i], row_of[j] = j, i
            free[j] = False
        else:
            left.append(i)
    for start in left:
        dist = np.full(m, np.inf)
        came = np.full(m, -1)
        open_ = np.ones(m, bool)
        i, low, rows = start, 0.0, [start]
        scanned = []
        while True:
            reach = low + cost[i] - u[i] - v
            better = open_ & (reach < dist)
            dist[better] = reach[better]
            came[better] = i
            j = int(np.where(open_, dist, np.inf).argmin())
            low = dist[j]
            open_[j] = False
            scanned.append(j)
            if row_of[j] < 0:
                break
            i = row_of[j]
            rows.append(i)
        end = scanned.pop()
        u[start] += low
        done = np.array(scanned, np.int64)
        u[row_of[done]] += low - dist[done]
        v[done] -= low - dist[done]
        j = end
        while True:
            i = came[j]
            row_of[j] = i
            col_of[i], j = j, col_of[i]
            if i == start:
                break
    return np.arange(n), col_of


_ROWS_AT_ONCE = 256
_TIE = 1e-12


def best_flow(score: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, column, how often) of an assignment with the greatest total score, where row i stands for
    supply[i] equal rows and column j for demand[j] equal columns.

    As best_assignment on the matrix with all of them, but of the size of the distinct ones:
    all rows that are left look for the nearest free columns at once, and every free column that is met is
    filled along the way that led to it. Totals are optimal up to 1e-12 a pair; among equal
    ones the order is fixed, but not that of best_assignment.
    """
    if supply.sum() > demand.sum():
        return sorted((i, j, n) for j, i, n in best_flow(score.T, demand, supply))
    n, m = score.shape
    top = score.max() if score.size else 0.0
    left, room = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    u, v = top - score.max(1), np.zeros(m)
    flow: list[dict[int, int]] = [{} for _ in range(m)]  # by column: how often each row has it

    for i in range(n):
        for j in np.flatnonzero((top - score[i] <= u[i]) & (room > 0)):
            if not left[i]:
                break
            units = int(min(left[i], room[j]))
            flow[j][i] = units
            left[i] -= units
            room[j] -= units

    while left.any():
        dist, came = np.full(m, np.inf), np.full(m, -1)
        closed = np.zeros(m, bool)
        row_dist, via = np.full(n, np.inf), np.full(n, -1)
        fresh, low = np.flatnonzero(left), 0.0
        row_dist[fresh] = 0.0
        while True:
            for a in range(0, len(fresh), _ROWS_AT_ONCE):
                rows = fresh[a : a + _ROWS_AT_ONCE]
                reach = (top - score[rows]) - u[rows][:, None] - v + low
                nearest = reach.argmin(0)
                reach = reach[nearest, np.arange(m)]
                better = ~closed & (reach < dist)
                dist[better], came[better] = reach[better], rows[nearest[better]]
            low = max(low, float(np.where(closed, np.inf, dist).min()))
            met = np.flatnonzero(~closed & (dist <= low + _TIE))
            ends = met[room[met] > 0]
            if len(ends):
                break
            closed[met] = True
            new = []
            for j in met:
                for i in flow[j]:
                    if row_dist[i] == np.inf:
                        row_dist[i], via[i] = low, j
                        new.append(i)
            fresh = np.array(sorted(new), np.int64)
        seen = row_dist < np.inf
        u[seen] += low - row_dist[seen]
        v[closed] -= np.maximum(low - dist[closed], 0.0)
        for end in ends.tolist():
            path, j = [], end
            while True:
                i = int(came[j])
                path.append((i, j))
                if via[i] < 0:
                    break
                j = int(via[i])
            root = path[-1][0]
            units = int(min([left[root], room[end], *(flow[via[i]].get(i, 0) for i, _ in path[:-1])]))
            if not units:
                continue
            left[root] -= units
            room[end] -= units
            for i, j in path:
                flow[j][i] = flow[j].get(i, 0) + units
                if via[i] >= 0:
                    before = flow[via[i]]
                    before[i] -= units
                    if not before[i]:
                        del before[i]
    return sorted((i, j, k) for j, rows in enumerate(flow) for i, k in rows.items())
