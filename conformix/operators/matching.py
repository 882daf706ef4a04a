"""Resolution of two feature tables: module keys, namespace remap, two-pass matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.similarity import Names, Side, Weights, class_scores, jaro_winkler
from .assignment import best_assignment, best_flow

NEAR_MISS = 0.15
REMAP_ABOVE = 0.8
#: Largest score matrix of one class of kinds within a module, in cells of 8 bytes; two are held at a time. Beyond it equal features share a row or column.
MATRIX_CELLS = 50_000_000
_CELLS_AT_ONCE = 1_000_000

_NEEDED = ["ord", "type", "normalized_name", "normalized_member_of", "normalized_namespace", "parameters", "normalized_return_types", "async"]


def with_module(features: DataFrame) -> DataFrame:
    """Adds `module`, the group in which a feature is compared."""
    return features.withColumn("module", names.module_key(F.col("namespace"), F.col("normalized_namespace")))


def most_similar(names: list[str], others: list[str], above: float) -> list[tuple[str, str, float]]:
    """(name, other, score) for each name that has a similarity over `above` with some other: the best, the first by name among equals."""
    others = sorted(others)
    short = [i for i, x in enumerate(others) if len(x) <= Names.MAX]
    long = [i for i, x in enumerate(others) if len(x) > Names.MAX]
    table, places = Names([others[i] for i in short]), np.array(short, np.int64)
    found = []
    for name in names:
        scores = np.zeros(len(others))
        if 0 < len(name) <= Names.MAX:
            scores[places] = table.scores(name, max(above, 0.0))
            rest = long
        else:
            rest = range(len(others))
        for i in rest:
            scores[i] = jaro_winkler(name, others[i])
        at = int(scores.argmax()) if len(others) else -1
        if at >= 0 and scores[at] > above:
            found.append((name, others[at], float(scores[at])))
    return found


_BLOCK = 2048


def remap_namespaces(base_keys: DataFrame, target_keys: DataFrame, above: float = REMAP_ABOVE) -> DataFrame:
    """(module, base_module) for target modules: themselves if base has them, else the
    most similar base module if its score exceeds `above`, the first by name among
    equals. Other target modules are missing. With no base modules all map to themselves.

    Both inputs are distinct values of a column `module`. Modules without an equal
    are compared in blocks of about 2,048 names of either side; a block gives the
    best of each of its target modules.
    """
    base = base_keys.select(F.col("module").alias("base_module"))
    same = target_keys.join(base, F.col("module") == F.col("base_module"), "left")
    exact = same.where("base_module is not null").select("module", "base_module")
    rest = same.where("base_module is null").select("module")
    n_base, n_rest = base.count(), rest.count()
    if not n_base:
        return target_keys.select("module", F.col("module").alias("base_module"))
    rows, cols = max(1, -(-n_rest // _BLOCK)), max(1, -(-n_base // _BLOCK))

    def spread(df: DataFrame, name: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(parts)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def compare(key, left, right):
        got = most_similar(left.column("module").to_pylist(), right.column("base_module").to_pylist(), above) if len(left) and len(right) else []
        return pa.table([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["module", "base_module", "score"])

    left, right = spread(rest, "module", "r", rows, "c", cols), spread(base, "base_module", "c", cols, "r", rows)
    near = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(compare, "module string, base_module string, score double")
    near = near.groupBy("module").agg(F.min_by("base_module", F.struct(-F.col("score"), F.col("base_module"))).alias("base_module"))
    return exact.unionByName(near)


def remap_target(base: DataFrame, target: DataFrame, above: float = REMAP_ABOVE) -> DataFrame:
    """The target's rows under base modules, with `pos`, their order within the module:
    original modules by first appearance, each in its own order. Rows whose module
    has no counterpart are dropped."""
    mapped = remap_namespaces(base.select("module").distinct(), target.select("module").distinct(), above)
    first = target.groupBy("module").agg(F.min("ord").alias("first"))
    placed = target.join(mapped.join(first, "module"), "module")
    return placed.withColumn("pos", F.struct("first", "ord")).drop("module").withColumnRenamed("base_module", "module")


def _scores(base: list[Side], target: list[Side], kind: str, weights: Weights) -> np.ndarray:
    """class_scores, by blocks of rows, so that only the result is as large as the matrix."""
    step = max(1, _CELLS_AT_ONCE // len(target))
    matrix = np.empty((len(base), len(target)))
    for a in range(0, len(base), step):
        matrix[a : a + step] = class_scores(base[a : a + step], target, kind, weights)
    return matrix


def match_lists(base: list[Side], target: list[Side], kind: str, alpha: float, weights: Weights = Weights()) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, float]], list[int], list[int]]:
    """For features of one class of kinds: solid pairs (score > alpha), then of the rest
    potential pairs (score > alpha - 0.15), and what is left on both sides. Pairs are
    ordered by base row. The matrix is scored once for both passes and isn't pruned, as
    pairs below the threshold compete in the assignment too."""
    rows, cols = np.arange(len(base)), np.arange(len(target))
    if kind not in ("C", "F", "M") or not len(rows) or not len(cols):
        return [], [], rows.tolist(), cols.tolist()
    if len(rows) * len(cols) > MATRIX_CELLS:
        return _match_equals(base, target, kind, alpha, weights)
    matrix = _scores(base, target, kind, weights)
    found = []
    for threshold in (alpha, max(0.0, alpha - NEAR_MISS)):
        part = matrix if matrix.shape == (len(rows), len(cols)) else matrix[np.ix_(rows, cols)]
        at = zip(*best_assignment(part)) if part.size else ()
        pairs = [(int(rows[x]), int(cols[y]), float(part[x, y])) for x, y in at if part[x, y] > threshold]
        found.append(pairs)
        rows = np.setdiff1d(rows, [p[0] for p in pairs], assume_unique=True)
        cols = np.setdiff1d(cols, [p[1] for p in pairs], assume_unique=True)
    return found[0], found[1], rows.tolist(), cols.tolist()


def _match_equals(base: list[Side], target: list[Side], kind: str, alpha: float, weights: Weights):
    """match_lists for modules of many equal features: the matrix has a row or column for each distinct one.

    Totals of both passes are the best; which of several optimal assignments is returned, and
    which of equal features, follows the order of rows, but not as in match_lists.
    """
    sides = []
    for features in (base, target):
        at: dict[Side, list[int]] = {}
        for i, x in enumerate(features):
            at.setdefault(x, []).append(i)
        sides.append((list(at), list(at.values())))
    (xs, left), (ys, right) = sides
    if len(xs) * len(ys) > MATRIX_CELLS:
        raise ValueError(f"a module has {len(xs) * len(ys)} pairs of different features of one kind, more than the limit of {MATRIX_CELLS}")
    matrix = _scores(xs, ys, kind, weights)
    found = []
    for threshold in (alpha, max(0.0, alpha - NEAR_MISS)):
        flow = best_flow(matrix, np.array([len(x) for x in left]), np.array([len(y) for y in right]))
        pairs = []
        for i, j, n in flow:
            if matrix[i, j] > threshold:
                pairs += zip(left[i][:n], right[j][:n], [float(matrix[i, j])] * n)
                left[i], right[j] = left[i][n:], right[j][n:]
        found.append(sorted(pairs))
    return found[0], found[1], sorted(x for rest in left for x in rest), sorted(y for rest in right for y in rest)


_OUT = "module string, kind string, base_ord long, target_ord long, score double, first long, at long"
_OUT_TYPES = {"module": pa.string(), "kind": pa.string(), "base_ord": pa.int64(), "target_ord": pa.int64(), "score": pa.float64(), "first": pa.int64(), "at": pa.int64()}
_OUT_ROWS = 10_000

Place = tuple[int, int, int]  # ord, and first and ord of pos


def _match_module(module: str, cls: str, base: list[tuple[Place, Side]], target: list[tuple[Place, Side]], alpha: float, weights: Weights) -> Iterator[tuple]:
    solid, potential, only_b, only_t = match_lists([x for _, x in base], [x for _, x in target], cls, alpha, weights)
    for kind, pairs in (("solid", solid), ("potential", potential)):
        for i, j, score in pairs:
            (bo, *pos), tg = base[i][0], target[j][0][0]
            yield module, kind, bo, tg, score, *pos
    for i in only_b:
        yield module, "base_only", base[i][0][0], None, 0.0, *base[i][0][1:]
    for j in only_t:
        yield module, "target_only", None, target[j][0][0], 0.0, *target[j][0][1:]


def _match_sorted(alpha: float, weights: Weights):
    """Matches rows sorted by module, class of kinds, side and place; holds those of one module and class, equal features once."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str], tuple[list, list]]]:
        key, found, known = None, ([], []), {}
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["module"], r["cls"])
                if own != key:
                    if key is not None:
                        yield key, found
                    key, found, known = own, ([], []), {}
                x = Side.of(r)
                found[r["side"]].append(((r["ord"], r["first"], r["at"]), known.setdefault(x, x)))
        if key is not None:
            yield key, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT_TYPES.values())], names=list(_OUT_TYPES))

        rows: list[tuple] = []
        for (module, cls), (base, target) in groups(batches):
            for row in _match_module(module, cls, base, target, alpha, weights):
                rows.append(row)
                if len(rows) >= _OUT_ROWS:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return run


def match_features(base: DataFrame, target: DataFrame, alpha: float = 0.8, weights: Weights = Weights()) -> DataFrame:
    """Matches two feature tables with `module` (the target's after remap_target).

    Returns module, kind (solid, potential, base_only, target_only), base_ord,
    target_ord, score, and place, the order within module and kind. One shuffle
    of both sides, by module and class of kinds: kinds of different classes
    score 0, so each class is solved by itself. A task reads its rows sorted and
    solves one group after the other, so many small modules cost no more than their rows.
    """
    own = F.struct(F.lit(0).cast("long").alias("first"), "ord")

    def side(df: DataFrame, n: int) -> DataFrame:
        pos = F.col("pos") if "pos" in df.columns else own
        return df.select("module", names.kind_class(F.col("type")).alias("cls"), F.lit(n).alias("side"), pos["first"].alias("first"), pos["ord"].alias("at"), *_NEEDED)

    both = side(base, 0).unionByName(side(target, 1)).repartition("module", "cls").sortWithinPartitions("module", "cls", "side", "first", "at")
    found = both.mapInArrow(_match_sorted(alpha, weights), _OUT)
    order = Window.partitionBy("module", "kind").orderBy("first", "at")
    return found.select("module", "kind", "base_ord", "target_ord", "score", (F.row_number().over(order) - 1).cast("long").alias("place"))
