"""Quality classifier: cumulative-link regression of graded ratings on hashed text.

One weight vector w over hashed features is shared by all grades, and ordered
thresholds b_1 < b_2 < ... separate them: P(grade <= k) = sigmoid(b_(k+1) - w.x).
The expected grade and the tail P(grade >= g) follow, and documents are selected
by the tail.

A document's features are means over its words of hashed indicators: the folded
word, the separators after it, its letter case, its length, whether it repeats
one of the two words before it, and the last with the separators.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jobs, texts

U64 = np.uint64
BITS = 16
KINDS = 5
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1


class Model(NamedTuple):
    """Weights by feature, and the ordered thresholds between the grades."""

    weights: np.ndarray
    bounds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for each score and each g from 1."""
        return 1 / (1 + np.exp(np.clip(self.bounds[None, :] - score[:, None], -500, 500)))


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, one row of KINDS for each word, and offsets of words by document."""
    words = texts.Words(buf, off)
    n = len(words)
    h = words.hashed()
    upper, lower = (np.concatenate(([0], np.cumsum(x[buf]))) for x in (_UPPER, _LOWER))
    n_up, n_low = upper[words.end] - upper[words.start], lower[words.end] - lower[words.start]
    shape = np.where(n_up == 0, 0, np.where(n_low == 0, np.where(n_up > 1, 3, 1), np.where(n_up > 1, 2, 1)))
    row = words.row()
    gap_end = np.minimum(np.append(words.start[1:], len(buf)) if n else words.start, off[row + 1])
    gap = texts.range_hash(texts._BYTE_CODE[buf], words.end, np.minimum(gap_end, words.end + 4))
    again = np.zeros(n, bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
    size = np.minimum((words.end - words.start) // 3, 10)
    kinds = (h, gap ^ U64(0x51), shape.astype(U64) * U64(77) + size.astype(U64), gap + shape.astype(U64), again.astype(U64) + U64(1000))
    out = np.empty((n, KINDS), np.int32)
    for k, x in enumerate(kinds):
        out[:, k] = (texts.mix(x * U64(KINDS) + U64(k)) >> U64(64 - BITS)).astype(np.int32)
    return out, words.first


def scores(weights: np.ndarray, idx: np.ndarray, first: np.ndarray) -> np.ndarray:
    """w.x of each document; 0 for one without words."""
    each = weights[idx].sum(1, dtype=np.float64)
    total = np.concatenate(([0.0], np.cumsum(each)))
    count = np.diff(first)
    return np.where(count > 0, (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1), 0.0)


def fit_arrays(idx: np.ndarray, first: np.ndarray, grade: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-6) -> Model:
    """Maximum likelihood by Adam over all rows at once; deterministic."""
    top = int(grade.max()) if len(grade) else 0
    if top < 1:
        raise jobs.NotEnoughLabels("two different grades are needed at least")
    count = np.diff(first)
    row = np.repeat(np.arange(len(grade)), count)
    # distinct features of each document with their mean
    key = (row[:, None].astype(np.int64) << BITS | idx).ravel()
    key, times = texts.distinct(key)
    row, col = key >> BITS, key & ((1 << BITS) - 1)
    value = times / np.maximum(count, 1)[row]
    w = np.zeros(1 << BITS)
    raw = np.concatenate(([-1.0], np.zeros(top - 1)))  # first threshold, then logs of the steps
    moments = [np.zeros(len(w)), np.zeros(len(w)), np.zeros(top), np.zeros(top)]
    at = np.arange(len(grade))
    for t in range(1, steps + 1):
        bounds = np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))
        s = np.bincount(row, value * w[col], len(grade))
        edge = np.concatenate(([-np.inf], bounds, [np.inf]))
        z = edge[None, :] - s[:, None]
        cum = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        cum[:, 0], cum[:, -1] = 0, 1
        p = np.maximum(cum[at, grade + 1] - cum[at, grade], 1e-9)
        slope = cum * (1 - cum)
        g_s = (slope[at, grade + 1] - slope[at, grade]) / p / len(grade)
        g_edge = np.zeros((len(grade), top + 2))
        g_edge[at, grade + 1] -= slope[at, grade + 1] / p
        g_edge[at, grade] += slope[at, grade] / p
        g_bounds = g_edge[:, 1:-1].sum(0) / len(grade)
        g_raw = np.cumsum(g_bounds[::-1])[::-1].copy()
        g_raw[1:] *= np.exp(raw[1:])
        g_w = np.bincount(col, value * g_s[row], len(w)) + decay * w
        for x, g, m, v, lr in ((w, g_w, moments[0], moments[1], rate), (raw, g_raw, moments[2], moments[3], rate / 3)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(w.astype(np.float32), np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:])))))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    idx, size, grade = [], [], []
    for batch in batches:
        for part, buf, off in texts.chunks(batch, "text"):
            i, first = features(buf, off)
            idx.append(i)
            size.append(np.diff(first))
            grade.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
    grade = np.concatenate(grade) if grade else np.zeros(0, np.int64)
    if len(grade) == 0 or grade.min() == grade.max():
        return
    model = fit_arrays(np.concatenate(idx), np.concatenate(([0], np.cumsum(np.concatenate(size)))), grade)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bounds.tobytes()], pa.binary())], ["weights", "bounds"])


def fit(docs: DataFrame, ratings: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Fits the model to documents with ratings from 0 up.

    At most `max_rows` rated documents are used, those whose ids hash lowest, so
    the sample is the same in each run; where ids repeat, `max_rows` bounds the
    rows, too. Rows with NULL id, text or rating are left out. Raises NotEnoughLabels where fewer than two grades are left.
    """
    rated = jobs.picked(ratings, id=id_col, grade=grade_col).where("id is not null and grade is not null")
    rated = rated.select(F.col("id").cast("long").alias("id"), F.col("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(max_rows)
    texts_ = jobs.picked(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts_.join(F.broadcast(sample), "id").select("grade", "text", F.xxhash64("id", "text").alias("h"))
    rows = rows.orderBy("h", "grade").limit(max_rows)  # where ids repeat, these are more than the sample
    model = rows.select("grade", "text").mapInArrow(jobs.tidy(_fit_rows), "weights binary, bounds binary").collect()
    if not model:
        raise jobs.NotEnoughLabels("fewer than two different ratings")
    return Model(np.frombuffer(model[0]["weights"], np.float32), np.frombuffer(model[0]["bounds"]))


def _score(model: Model, text_at: int, at_least: int):
    def run(batches):
        for batch in batches:
            for part, buf, off in texts.chunks(batch, batch.schema.names[text_at]):
                s = scores(model.weights, *features(buf, off))
                tails = model.tails(s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(tails.sum(1), 6)), pa.array(np.round(tails[:, at_least - 1], 6))], [*part.schema.names, "e", "t"])

    return jobs.tidy(run)


def score(docs: DataFrame, model: Model, at_least: int = 1, text_col: str = "text") -> DataFrame:
    """All columns and rows, with `expected_grade` and `tail`, P(grade >= at_least).

    Columns of these names are replaced. Empty and NULL texts have no features
    and get what the thresholds alone say. Both numbers are rounded to 6 places.
    No documents: no rows.
    """
    if not 1 <= at_least <= len(model.bounds):
        raise ValueError(f"at_least must be from 1 to {len(model.bounds)}")
    names = docs.columns
    keep = [i for i, c in enumerate(names) if c not in ("expected_grade", "tail")]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in keep])
    schema = T.StructType([*plain.schema.fields, T.StructField("e", T.DoubleType()), T.StructField("t", T.DoubleType())])
    kept = [names[i] for i in keep]
    return plain.mapInArrow(_score(model, kept.index(text_col), at_least), schema).toDF(*kept, "expected_grade", "tail")


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 0 poor, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
