"""Toxic spans by a linear-chain conditional random field.

Two tags, ordinary and toxic. A word's features are hashes of the folded word
and of its first 3 to 8 bytes; each has one weight in favour of the toxic tag,
and there are four transition weights and two for the first word. Training
maximises the likelihood of labelled words; forward-backward marginals give each
word's probability of being toxic.

Forward and backward recursions run over all words of a chunk of documents at
once: the words are laid out in lanes of equal length, each lane first yields its
2 x 2 transfer matrix, the matrices are chained, and then each lane runs from its
own start vector. A document's first word resets the chain, so lanes needn't
respect documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jobs, texts

U64 = np.uint64
BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
KINDS = 1 + len(PREFIXES)
_LANE = 256


class Model(NamedTuple):
    """weights: by feature; start: of both tags; trans[a, b]: from a to b; cut: least score of a toxic document."""

    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    cut: float


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, texts.Words]:
    """KINDS feature numbers of each word; a prefix as long as the word counts as none (feature 0)."""
    words = texts.Words(buf, off)
    codes = texts._BYTE_CODE[texts.fold(buf)]
    out = np.zeros((len(words), KINDS), np.int32)
    out[:, 0] = (texts.range_hash(codes, words.start, words.end) >> U64(64 - BITS)).astype(np.int32) | 1
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(words.end - words.start > size)
        at = words.start[long]
        out[long, k] = (texts.mix(texts.range_hash(codes, at, at + size)) >> U64(64 - BITS)).astype(np.int32) | 1
    return out, words


def marginals(gain: np.ndarray, begins: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(toxic) of each word, and the logarithm of the sum over all taggings of all documents.

    gain: emission in favour of the toxic tag; begins: true at the first word of
    each document. With pairs, also the expected number of each transition and
    of each tag at a first word.
    """
    n = len(gain)
    if not n:
        return (np.zeros(0), 0.0, np.zeros((2, 2)), np.zeros(2)) if pairs else (np.zeros(0), 0.0)
    lanes = -(-n // _LANE)
    pad = lanes * _LANE - n
    e = np.exp(np.clip(np.append(gain, np.zeros(pad)), -30, 30)).reshape(lanes, _LANE).T.copy()
    first = np.append(begins, np.ones(pad, bool)).reshape(lanes, _LANE).T.copy()
    move, init = np.exp(trans), np.exp(start)
    # transfer of step t, from tag a to tag b: move[a, b] (init[b] at a first word) times the emission of b
    step = [[np.where(first, init[b], move[a, b]) * (e if b else 1.0) for b in (0, 1)] for a in (0, 1)]
    (m00, m01), (m10, m11) = (np.ones(lanes), np.zeros(lanes)), (np.zeros(lanes), np.ones(lanes))
    for t in range(_LANE):
        s00, s01, s10, s11 = step[0][0][t], step[0][1][t], step[1][0][t], step[1][1][t]
        m00, m01, m10, m11 = m00 * s00 + m01 * s10, m00 * s01 + m01 * s11, m10 * s00 + m11 * s10, m10 * s01 + m11 * s11
        scale = 1 / (m00 + m01 + m10 + m11)
        m00, m01, m10, m11 = m00 * scale, m01 * scale, m10 * scale, m11 * scale
    a0, a1 = np.empty(lanes), np.empty(lanes)
    b0, b1 = np.empty(lanes), np.empty(lanes)
    x, y = 0.5, 0.5
    k00, k01, k10, k11 = m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist()
    for i in range(lanes):
        a0[i], a1[i] = x, y
        x, y = x * k00[i] + y * k10[i], x * k01[i] + y * k11[i]
        z = x + y
        x, y = x / z, y / z
    x, y = 0.5, 0.5
    for i in range(lanes - 1, -1, -1):
        b0[i], b1[i] = x, y
        x, y = k00[i] * x + k01[i] * y, k10[i] * x + k11[i] * y
        z = x + y
        x, y = x / z, y / z
    f0, f1, logs = np.empty_like(e), np.empty_like(e), np.zeros(lanes)
    norm = np.empty_like(e)
    for t in range(_LANE):
        # at a first word both rows of the transfer are equal, so what came before counts only as its sum, 1
        a0, a1 = a0 * step[0][0][t] + a1 * step[1][0][t], a0 * step[0][1][t] + a1 * step[1][1][t]
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
        f0[t], f1[t], norm[t] = a0, a1, z
    logs = np.log(norm).T.ravel()[:n].sum()
    toxic = np.empty_like(e)
    moved = np.zeros((2, 2))
    before0 = np.empty_like(e)
    before0[1:] = f0[:-1]
    before0[0, 0], before0[0, 1:] = 0.5, f0[-1, :-1]
    before1 = 1 - before0
    real = np.append(np.ones(n, bool), np.zeros(pad, bool)).reshape(lanes, _LANE).T
    for t in range(_LANE - 1, -1, -1):
        p0, p1 = f0[t] * b0, f1[t] * b1
        toxic[t] = p1 / (p0 + p1)
        if pairs:
            use = real[t] & ~first[t]
            w = [[(before0, before1)[a][t] * step[a][b][t] * (b0, b1)[b] for b in (0, 1)] for a in (0, 1)]
            total = w[0][0] + w[0][1] + w[1][0] + w[1][1]
            for a in (0, 1):
                for b in (0, 1):
                    moved[a, b] += (w[a][b] / total)[use].sum()
        b0, b1 = step[0][0][t] * b0 + step[0][1][t] * b1, step[1][0][t] * b0 + step[1][1][t] * b1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    toxic = toxic.T.ravel()[:n]
    if pairs:
        at = toxic[np.flatnonzero(begins)]
        return toxic, logs, moved, np.array([(1 - at).sum(), at.sum()])
    return toxic, logs


def compact(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of features, and the number of each word's row among them."""
    key = np.zeros(len(idx), U64)
    for k in range(idx.shape[1]):
        key = texts.mix(key + idx[:, k].astype(U64) + U64(k << 40))
    _, at, word = np.unique(key, return_index=True, return_inverse=True)
    return idx[at], word.astype(np.int32)


#: Words of whole documents that the fit's recursions hold at once.
_BLOCK_WORDS = 500_000


def _all_marginals(gain: np.ndarray, begins: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """marginals() with pairs, over blocks of documents."""
    p, logs, moved, begun, lo = np.empty(len(gain)), 0.0, np.zeros((2, 2)), np.zeros(2), 0
    while lo < len(first) - 1:
        hi = max(int(np.searchsorted(first, first[lo] + _BLOCK_WORDS, "right")) - 1, lo + 1)
        a, b = first[lo], first[hi]
        own = marginals(gain[a:b], begins[a:b], start, trans, pairs=True)
        p[a:b], logs, moved, begun, lo = own[0], logs + own[1], moved + own[2], begun + own[3], hi
    return p, logs, moved, begun


def fit_arrays(kinds: np.ndarray, word: np.ndarray, first: np.ndarray, tags: np.ndarray, steps: int = 60, rate: float = 0.3, decay: float = 0.05, enough: float = 1e-3) -> Model:
    """Maximum likelihood of labelled words by Adam over all of them; the cut is 0.

    kinds: features of each distinct word; word: which one each word is. Ends
    before `steps` when five steps gained less than `enough` of the loss.
    """
    n = len(tags)
    begins = np.zeros(n + 1, bool)
    begins[first[:-1]] = True
    begins = begins[:n]
    w, start, trans = np.zeros(1 << BITS), np.array([0.0, -3.0]), np.array([[0.0, -3.0], [0.0, -1.0]])
    had_start = np.bincount(tags[begins], minlength=2)
    follow = np.flatnonzero(~begins)
    had_trans = np.bincount(tags[follow - 1] * 2 + tags[follow], minlength=4).reshape(2, 2)
    on = np.flatnonzero(tags == 1)
    flat = kinds.ravel()

    def spread(x: np.ndarray) -> np.ndarray:
        """Sums over words as sums over features."""
        return np.bincount(flat, np.repeat(np.bincount(word, x, len(kinds)), KINDS), len(w))

    had = spread((tags == 1).astype(float))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, start, trans)]
    losses = []
    for t in range(1, steps + 1):
        gain = w[kinds].sum(1)[word]
        p, logs, moved, begun = _all_marginals(gain, begins, first, start, trans)
        losses.append(logs - gain[on].sum() - (had_start * start).sum() - (had_trans * trans).sum() + decay / 2 * (w @ w))
        if t > 6 and losses[-6] - losses[-1] < enough * abs(losses[-1]):
            break
        g_w = spread(p) - had + decay * w
        g_w[0] = 0
        grads = (g_w, begun - had_start + decay * start, moved - had_trans + decay * trans)
        for x, g, (m, v) in zip((w, start, trans), grads, moments):
            g = g / max(1, len(on))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(w.astype(np.float32), start, trans, 0.0)


def label_words(kinds: np.ndarray, word: np.ndarray, first: np.ndarray, toxic: np.ndarray, odds: float = 2.5, support: int = 4) -> np.ndarray:
    """Tags for the words of documents that are labelled as a whole.

    A word of a toxic document counts as toxic if one of its features is found
    in `support` toxic documents at least and, by the smoothed log odds, is much
    more common in toxic documents than in others.
    """
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    pair, _ = texts.distinct(row.astype(np.int64) * len(kinds) + word)
    key, _ = texts.distinct((((pair // max(1, len(kinds)))[:, None] << BITS) | kinds[pair % max(1, len(kinds))]).ravel())
    doc, col = key >> BITS, key & ((1 << BITS) - 1)
    bad = np.bincount(col[toxic[doc] == 1], minlength=1 << BITS)
    good = np.bincount(col[toxic[doc] == 0], minlength=1 << BITS)
    n_bad, n_good = max(1, (toxic == 1).sum()), max(1, (toxic == 0).sum())
    value = np.log((bad + 0.1) / n_bad) - np.log((good + 0.5) / n_good)
    strong = (value >= odds) & (bad >= support)
    strong[0] = False
    return (strong[kinds].any(1)[word] & (toxic[row] == 1)).astype(np.int64)


def unlike(h: np.ndarray, first: np.ndarray, share: float = 0.3) -> np.ndarray:
    """True for documents of which at most `share` of the 4-word sequences is in one before; h: hashes of words.

    Copies in the sample would make their rare words look like evidence. Sequences
    are known by a hash of 26 bits.
    """
    grams, off = texts.gram_hashes(h, first, 4)
    grams = (grams >> U64(38)).astype(np.int32)
    seen = np.zeros(1 << 26, bool)
    keep = np.zeros(len(first) - 1, bool)
    for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        keep[r] = seen[grams[a:b]].sum() <= share * (b - a)
        if keep[r]:
            seen[grams[a:b]] = True
    return keep


def _begins(words: texts.Words) -> np.ndarray:
    begins = np.zeros(len(words) + 1, bool)
    begins[words.first] = True
    return begins[: len(words)]


def document_scores(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected share of toxic words of each document; 0 for one without words."""
    total = np.concatenate(([0.0], np.cumsum(p)))
    count = np.diff(first)
    return np.where(count > 0, (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1), 0.0)


def fit_documents(kinds: np.ndarray, word: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> Model:
    """Labels words, fits the field, and sets the cut where documents' scores divide best."""
    keep = unlike(texts.mix(kinds[:, 0].astype(U64))[word], first)
    count = np.diff(first)
    word, first, own = word[texts.ranges(first[:-1][keep], count[keep])], np.concatenate(([0], np.cumsum(count[keep]))), toxic[keep]
    model = fit_arrays(kinds, word, first, label_words(kinds, word, first, own))
    begins = np.zeros(len(word) + 1, bool)
    begins[first] = True
    p = _all_marginals(model.weights[kinds].sum(1, dtype=np.float64)[word], begins[: len(word)], first, model.start, model.trans)[0]
    s = document_scores(p, first)
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate(([0], np.cumsum(own[order] == 1))) + np.concatenate((np.cumsum((own[order] == 0)[::-1])[::-1], [0]))
    edges = np.concatenate(([0.0], (s[order][1:] + s[order][:-1]) / 2, [1.0]))
    good = np.flatnonzero(wrong == wrong.min())
    return model._replace(cut=float(max(edges[good[len(good) // 2]], 1e-6)))


def _fit_rows(batches):
    kinds, word, size, toxic, n = [], [], [], [], 0
    for batch in batches:
        for part, buf, off in texts.chunks(batch, "text"):
            i, words = features(buf, off)
            own, at = compact(i)
            kinds.append(own)
            word.append(at + n)
            n += len(own)
            size.append(np.diff(words.first))
            toxic.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
    if not toxic or len(np.unique(np.concatenate(toxic))) < 2:
        return
    kinds, same = compact(np.concatenate(kinds))
    m = fit_documents(kinds, same[np.concatenate(word)], np.concatenate(([0], np.cumsum(np.concatenate(size)))), np.concatenate(toxic))
    yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([np.concatenate([m.start, m.trans.ravel(), [m.cut]]).tobytes()], pa.binary())], ["weights", "rest"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Fits the field to documents labelled 0 or 1 as a whole.

    At most `max_rows` labelled documents are used, those whose ids hash lowest;
    where ids repeat, `max_rows` bounds the rows, too. Rows with NULL id, text or label are left out. Raises NotEnoughLabels unless
    both labels are among the rest.
    """
    rated = jobs.picked(labels, id=id_col, toxic=toxic_col).where("id is not null and toxic is not null")
    rated = rated.select(F.col("id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    sample = rated.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_rows)
    own = jobs.picked(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = own.join(F.broadcast(sample), "id").select("toxic", "text", F.xxhash64("id", "text").alias("h"))
    rows = rows.orderBy("h", "toxic").limit(max_rows)  # where ids repeat, these are more than the sample
    got = rows.select("toxic", "text").mapInArrow(jobs.tidy(_fit_rows), "weights binary, rest binary").collect()
    if not got:
        raise jobs.NotEnoughLabels("toxic and other documents are needed")
    rest = np.frombuffer(got[0]["rest"])
    return Model(np.frombuffer(got[0]["weights"], np.float32), rest[:2], rest[2:6].reshape(2, 2), float(rest[6]))


_SPAN = "array<struct<start:int,end:int,score:double>>"


def _tag(model: Model, text_at: int):
    def run(batches):
        for batch in batches:
            for part, buf, off in texts.chunks(batch, batch.schema.names[text_at]):
                idx, words = features(buf, off)
                p, _ = marginals(model.weights[idx].sum(1, dtype=np.float64), _begins(words), model.start, model.trans)
                s = np.round(document_scores(p, words.first), 6)
                # spans: runs of words with P >= 1/2; characters, not bytes
                a, b = texts.runs(p >= 0.5, words.first)
                row = np.searchsorted(words.first, a, "right") - 1
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80))) if len(buf) else np.zeros(1, np.int64)
                base = chars[off[row]]
                top = np.maximum.reduceat(p, a) if len(a) else np.zeros(0)
                span = pa.StructArray.from_arrays([pa.array((chars[words.start[a]] - base).astype(np.int32)), pa.array((chars[words.end[b - 1]] - base).astype(np.int32)), pa.array(np.round(top, 6))], ["start", "end", "score"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), span)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array(s >= model.cut), lists], [*part.schema.names, "s", "t", "l"])

    return jobs.tidy(run)


def tag(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns and rows, with toxic_score, is_toxic and toxic_spans.

    toxic_score is the expected share of toxic words, is_toxic whether it
    reaches the model's cut; toxic_spans are the runs of words that are toxic
    with probability 1/2 or more: character offsets, the end excluded, and the
    highest probability. Columns of these names are replaced. Empty and NULL
    texts score 0, aren't toxic and have no spans. No documents: no rows.
    """
    new = ("toxic_score", "is_toxic", "toxic_spans")
    names = docs.columns
    keep = [i for i, c in enumerate(names) if c not in new]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in keep])
    extra = T._parse_datatype_string(f"s double, t boolean, l {_SPAN}")
    kept = [names[i] for i in keep]
    return plain.mapInArrow(_tag(model, kept.index(text_col)), T.StructType([*plain.schema.fields, *extra.fields])).toDF(*kept, *new)
