"""Kernels and operators over text, against brute force."""

import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conformix.llm import bpe, context_tree, jobs, ngram_join, packing, substring_dedup, texts

WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
# NULLs, empty and blank texts, ties and repeated rows, a very long text, clashing extra columns
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
BASE = " ".join(f"tok{i}" for i in range(120))
DOCS = [
    (1, BASE), (2, BASE), (3, BASE.replace("tok50", "other")), (4, "intro words " + " ".join(f"tok{i}" for i in range(10, 70)) + " tail"), (5, ""), (6, "  \n "), (7, None), (None, BASE), (None, None), (8, LONG), (9, LONG + " end"),
    (10, "one"), (11, "One!"), (12, "ÉCOLE été naïve"), (13, "école ÉTÉ NAÏVE."), (14, "solo text here that nobody shares at all"), (2, BASE), (15, "rep " * 300), (16, "rep " * 280),
]


def frame(spark, rows=None, schema="doc_id long, text string"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, schema)
    return df.withColumn("id", F.lit("x")).withColumn("class", F.lit("c")).withColumn("removed_words", F.lit(-1)).withColumn("n_tokens", F.lit("y"))


def clash(df):
    """The same rows with columns that differ from the wanted ones in case alone."""
    names = df.columns
    return df.select(*names, df["id"], df["class"]).toDF(*names, "TEXT", "DOC_ID")


def words(text):
    return [w.lower() for w in WORD.findall(text or "")]


def test_words_and_hashes():
    t = ["Ab cd", "", "ÀÉ x-1", "ab CD", "日本 ñ"]
    w = texts.Words(*texts.text_buffer(pa.array(t)))
    h = w.hashed()
    assert np.diff(w.first).tolist() == [2, 0, 3, 2, 2] and h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 7


def brute_pairs(rows, n, t):
    sets = {}
    for i, x in rows:
        if i is None or x is None:
            continue
        w = words(x)
        g = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        if g:
            sets[i] = g
    return {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def brute_join(rows, n, t):
    """(id, class_id, n_copies, n_links, group_id) by comparing all sets."""
    entries = set()
    for i, x in rows:
        if i is not None:
            w = words(x)
            entries.add((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    sets = {s: [i for i, own in entries if own == s] for _, s in entries if s}
    links = {s: [o for o in sets if o != s and len(s & o) >= t * len(s | o)] for s in sets}
    group = {s: min(ids) for s, ids in sets.items()}
    first = dict(group)
    for _ in sets:
        for s in sets:
            # classes with the same lowest document are of one group too
            group[s] = min([group[s], *(group[o] for o in links[s]), *(group[o] for o in sets if first[o] == first[s])])
    return {(i, first[s], len(sets[s]) - 1, len(links[s]), group[s]) if s else (i, i, 0, 0, i) for i, s in entries}


def joined(spark, rows, t, n, block_rows=4096, form=lambda df: df):
    got = ngram_join.ngram_jaccard_join(form(frame(spark, rows)), t, n, block_rows)
    assert got.columns == ["doc_id", "class_id", "n_copies", "n_links", "group_id"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block_rows", [4096, 2])
def test_ngram_join(spark, block_rows):
    rows = [*DOCS, (2, "a second text of a document"), (3, "a second text of a document"), (1, BASE.upper())]
    assert joined(spark, rows, 0.6, 5, block_rows, clash) == brute_join(rows, 5, 0.6)


def test_ngram_join_random(spark):
    rng = np.random.RandomState(3)
    rows = []
    for g in range(12):
        base = [f"v{x}" for x in rng.randint(0, 60, rng.randint(8, 60))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for k in range(rng.randint(0, 5)):
                own[rng.randint(len(own))] = f"v{rng.randint(0, 60)}"
            rows.append((len(rows), " ".join(own)))
    for t, n in ((0.5, 2), (0.8, 3), (1.0, 1)):
        assert joined(spark, rows, t, n, 5) == brute_join(rows, n, t)
    pairs = {(r.id_a, r.id_b, r.overlap) for r in ngram_join.class_pairs(frame(spark, rows), 0.5, 3, 5).collect()}
    first = {r[0] for r in brute_join(rows, 3, 0.5) if r[0] == r[1]}
    assert pairs == {p for p in brute_pairs(rows, 3, 0.5) if p[0] in first and p[1] in first}


def test_ngram_join_defaults_are_those_of_the_sql(spark):
    """Word 3-grams at 0.7, in the functions and in the SQL; the last copy lies below 0.6 by 5-grams."""
    import duckdb

    from conformix.llm import queries

    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base)), *((k, " ".join(f"e{k}x{i}" if i % 200 in range(5, 5 + 18 * k, 18) else w for i, w in enumerate(base))) for k in (2, 8, 11)), (12, " ".join(base)), (13, None), (14, "")]
    want = brute_join(rows, 3, 0.7)
    assert (11, 11, 0, 3, 0) in want - brute_join(rows, 5, 0.6)
    assert {tuple(r) for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()} == want
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        assert set(db.execute(queries.ORACLE_SQL["op4_ngram_jaccard_join"]).fetchall()) == want


def test_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_join(frame(spark, [])).count() == 0
    assert ngram_join.class_pairs(frame(spark, [(1, "a")])).count() == 0


@pytest.mark.parametrize("t", [0.3, 0.45, 0.6, 0.7, 0.9, 1.0])
def test_linked_pairs_meet(t):
    """For all sizes, the heads of a linked pair share more keys than both classes leave out together."""
    for a in range(1, 300):
        b = np.arange(max(1, math.ceil(t * a - 1e-9)), a + 1)
        o = np.minimum(np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(int), b)
        b, o = b[o >= t * (a + b - o) - 1e-9], o[o >= t * (a + b - o) - 1e-9]
        (x_a, need_a), (x_b, need_b) = ngram_join._head(np.full(len(b), a), t), ngram_join._head(b, t)
        shared = np.minimum(np.where(x_a == a, o, x_a - (a - o)), np.where(x_b == b, o, x_b - (b - o)))
        assert (shared >= np.maximum(need_a, need_b)).all() and (shared > (need_a - 1) // 2 + (need_b - 1) // 2).all()


@pytest.mark.parametrize("bits", [27, 4])
def test_rows_of_some_ids(spark, monkeypatch, bits):
    """By the filter, and by the join that stands in for it where there are too many ids."""
    monkeypatch.setattr(jobs, "FILTER_BITS", bits)
    df, ids = spark.range(1000).selectExpr("id", "cast(id as string) as text"), spark.range(0, 1000, 50)
    got = {r.id for r in jobs.only(df, ids).collect()}
    assert set(range(0, 1000, 50)) <= got and len(got) < 60


@pytest.mark.parametrize("heavy, products", [(0, 4_000_000), (10, 50), (10**9, 1)])
def test_product_is_that_of_the_matrix(monkeypatch, heavy, products):
    """Sparse columns, dense panels and both, in pieces: overlaps are those of the whole matrix."""
    monkeypatch.setattr(ngram_join, "_HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "_PRODUCTS", products)
    rng = np.random.RandomState(3)
    for m, t in itertools.product((1, 2, 17, 40, 700), (0.3, 0.7, 1.0)):
        a = rng.rand(m, 30) < rng.rand(30) * rng.rand(m)[:, None] * 1.5
        n = a.sum(1) + rng.randint(0, 3, m)
        order = np.argsort(n, kind="stable")
        a, n = a[order].astype(int), n[order]
        row, col = np.nonzero(a)
        mixed = rng.permutation(len(row))
        i, j, o = ngram_join._overlaps(row[mixed], ngram_join._compact(col[mixed]), n, t)
        both = a @ a.T
        want = np.triu((both > 0) & (both >= t * (n[:, None] + n - both) - 1e-6), 1)
        assert sorted(zip(i, j, o)) == sorted((x, y, both[x, y]) for x, y in np.argwhere(want))


def test_packed_keys_come_back():
    """Keys of several sets by bucket; of equal sets one is sent."""
    rng = np.random.RandomState(5)
    packer = ngram_join._Packer(7)
    classes = rng.randint(-(1 << 62), 1 << 62, 40)
    classes[20:25] = classes[:5]
    counts = rng.randint(0, 30, 40)
    counts[20:25] = counts[:5]
    sets = {int(c): rng.randint(0, 1 << 62, n).astype(np.uint64) for c, n in zip(classes[:20].tolist() + classes[25:].tolist(), np.delete(counts, range(20, 25)))}
    packer.put(np.concatenate([sets[int(c)] for c in classes]), counts, classes, counts + 1)
    batch, want = packer.batch(), defaultdict(list)
    for c, keys in sets.items():
        for h in texts.mix(keys).tolist():
            want[h % 7].append((h >> 32, c & ngram_join._NUMBERS, len(keys) + 1))
    for r in batch.to_pylist():
        times = ngram_join._from_planes(r["counts"], 4)
        numbers, sizes = (np.repeat(x, times).tolist() for x in (ngram_join._from_ascending(r["classes"]), ngram_join._from_planes(r["sizes"], 4)))
        assert sorted(zip(np.frombuffer(r["keys"], "<u4").tolist(), numbers, sizes)) == sorted(want.pop(r["bucket"]))
    assert not want


def brute_removal(rows, least):
    owner = {}
    for i, x in rows:
        if i is not None and x is not None:
            w = words(x)
            for k in range(len(w) - least + 1):
                key = tuple(w[k : k + least])
                owner[key] = min(owner.get(key, i), i)
    out = []
    for i, x in rows:
        if i is None or x is None:
            out.append((i, x, 0))
            continue
        spans, w = [m.span() for m in WORD.finditer(x)], words(x)
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if owner[tuple(w[k : k + least])] < i:
                gone[k : k + least] = [True] * least
        kept = x[: spans[0][0]] if spans else x
        for k, (a, _) in enumerate(spans):
            if not gone[k]:
                kept += x[a : spans[k + 1][0] if k + 1 < len(spans) else len(x)]
        out.append((i, kept, sum(gone)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least, shard_rows", [(50, 4096), (7, 2)])
def test_substring_dedup(spark, least, shard_rows):
    got = substring_dedup.substring_dedup(frame(spark), least, shard_rows)
    assert got.columns == ["doc_id", "text", "id", "class", "n_tokens", "removed_words"]
    assert sorted(repr((r.doc_id, r.text, r.removed_words)) for r in got.collect()) == brute_removal(DOCS, least)


def test_substring_dedup_random(spark):
    rng = np.random.RandomState(4)
    rows = [(int(rng.randint(0, 40)), " ".join(f"{'ab' if rng.rand() < .9 else 'x'}{rng.randint(0, 3)}" for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    got = substring_dedup.substring_dedup(frame(spark, rows), 5, 3).collect()
    assert sorted(repr((r.doc_id, r.text, r.removed_words)) for r in got) == brute_removal(rows, 5)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_suffix_automaton():
    rng = np.random.RandomState(0)
    for _ in range(200):
        seqs = [rng.randint(0, 3, rng.randint(1, 12)).tolist() for _ in range(3)]
        a = substring_dedup.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        q = rng.randint(0, 4, 15).tolist()
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [i for i in range(15) if i >= 2 and tuple(q[i - 2 : i + 1]) in subs]
        assert [i for x, y in a.matches(q, 3) for i in range(x, y)] == want


def brute_code_lengths(docs, depth):
    """Each bit by P_w of the root with all counts over P_w of the root without its own."""
    count = defaultdict(lambda: [0, 0])

    def path(t, i):
        h = b"\0" * depth + t[:i]
        return [h[len(h) - d :] if d else b"" for d in range(depth + 1)]

    def decisions(x):
        node = 1
        for k in range(7, -1, -1):
            yield node, x >> k & 1
            node = 2 * node + (x >> k & 1)

    for t in docs:
        for i, x in enumerate(t):
            for c in path(t, i):
                for node, bit in decisions(x):
                    count[c, node][bit] += 1
    kids = defaultdict(list)
    for c, node in count:
        if c:
            kids[c[1:], node].append((c, node))
    known = {}

    def weighted(key, gone=(), bit=0):
        """log P_w, without one of the bit in the nodes `gone`."""
        if key not in gone and key in known:
            return known[key]
        a, b = count[key]
        if key in gone:
            a, b = a - (1 - bit), b - bit
        e = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        w = e if len(key[0]) == depth else float(np.logaddexp(e, sum(weighted(k, gone, bit) for k in kids[key]))) - math.log(2)
        if key not in gone:
            known[key] = w
        return w

    return [sum((weighted((b"", node), {(c, node) for c in path(t, i)}, bit) - weighted((b"", node))) / math.log(2) for i, x in enumerate(t) for node, bit in decisions(x)) for t in docs]


@pytest.mark.parametrize("depth, split", [(3, 1), (3, 64 << 30), (6, 50), (7, 64 << 30)])
def test_context_tree(spark, monkeypatch, depth, split):
    """With parts of a few n-grams, and contexts of two bytes in one home or several."""
    monkeypatch.setattr(context_tree, "_PART_BYTES", 40)
    monkeypatch.setattr(context_tree, "_SPLIT_BYTES", split)
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the cat sat on the hat", "äöü ñandú", "", "zzzzzzzzzzzz", "a", "the cat sat on the mat"])] + [(None, "no id"), (99, None)]
    got = sorted(context_tree.score(clash(frame(spark, rows)), depth).collect(), key=repr)
    want = brute_code_lengths([(t or "").encode() for _, t in rows], depth)
    assert len(got) == len(rows)
    for (i, t), bits in zip(rows, want):
        r = next(r for r in got if r.doc_id == i)
        assert r.code_bits == pytest.approx(bits, abs=2e-3)
        assert r.n_bytes == len((t or "").encode()) and (r.bits_per_byte is None) == (not t)
    by = {r.doc_id: r.bits_per_byte for r in got}
    assert by[0] == by[6] < by[1] < by[2]
    assert context_tree.score(frame(spark, []), depth).count() == 0


def test_context_tree_depth(spark):
    with pytest.raises(ValueError):
        context_tree.score(frame(spark, []), 8)


def test_kt_tables():
    a, b = np.array([0, 3, 20_000, 5]), np.array([0, 1, 7, 100_000])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert np.allclose(context_tree.log_kt(a, b), want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), min_size=1, max_size=9), st.integers(1, 12), st.sampled_from([0, 0.5, 1, 4]), st.sampled_from([0, 1, 8]))
def test_packing_is_optimal(units, window, trunc, cut):
    ends, docs = np.cumsum([u for u, _ in units]).tolist(), [d for _, d in units[:-1]] + [True]
    bound = [0, *ends]

    def cost(i, j):
        n = bound[j] - bound[i]
        return (window - n if n <= window else trunc * (n - window)) + (0 if docs[j - 1] else cut)

    best = [0.0]
    for j in range(1, len(bound)):
        best.append(min(best[i] + cost(i, j) for i in range(j)))
    cuts, total = packing.choose_cuts(ends, docs, window, 1, trunc, cut)
    edges = [0] + [c + 1 for c in cuts]
    assert total == pytest.approx(best[-1]) and total == pytest.approx(sum(cost(i, j) for i, j in zip(edges, edges[1:]))) and edges[-1] == len(ends)


def test_pack(spark):
    got = packing.pack(clash(frame(spark)), window=100, shard_bytes=1000).orderBy("shard", "window_no").collect()
    assert all(r.n_tokens <= 100 and r.n_padding == 100 - r.n_tokens for r in got)
    assert sum(r.n_tokens + r.n_truncated for r in got) == sum(len(words(t)) for _, t in DOCS)
    by_text = defaultdict(list)
    for r in got:
        assert r.text.count("\n\n") >= len(r.pieces) - 1
        for p in r.pieces:
            by_text[p.doc_id].append((p.start, p.end))
    assert by_text[14] == [(0, len(DOCS[15][1]))] and by_text[5] == [(0, 0)] and set(by_text) == {i for i, _ in DOCS}
    assert packing.pack(frame(spark, [])).count() == 0


def test_pack_keeps_text_without_marks(spark):
    """Both end half a window past a full one, where to pad costs less than to drop."""
    rows = [(0, " ".join(f"u{i}" for i in range(20_050))), (600, "A short one. " * 3 + " ".join(f"v{i}" for i in range(1_041)))]
    got = packing.pack(frame(spark, rows), window=100, shard_bytes=1000).orderBy("shard", "window_no").collect()
    assert all(r.n_tokens <= 100 and r.n_truncated == 0 for r in got)
    assert words(" ".join(r.text for r in got)) == [w for _, t in rows for w in words(t)]
    for i, t in rows:
        spans = [(p.start, p.end) for r in got for p in r.pieces if p.doc_id == i]
        assert "".join(t[a:b] for a, b in spans) == t


def test_pack_brute_force_small(spark):
    rows = [(i, " ".join(["w."] * n)) for i, n in enumerate([5, 3, 9, 1, 7, 2])]
    got = packing.pack(frame(spark, rows), 8, 1 << 20, 1, 4, 2).collect()
    ends, docs = list(range(1, 28)), [False] * 27
    for n in np.cumsum([5, 3, 9, 1, 7, 2]):
        docs[n - 1] = True
    _, total = packing.choose_cuts(ends, docs, 8, 1, 4, 2)
    cuts = np.cumsum([r.n_tokens + r.n_truncated for r in sorted(got, key=lambda r: r.window_no)])
    assert total == sum(r.n_padding + 4 * r.n_truncated for r in got) + 2 * sum(not docs[c - 1] for c in cuts)


def windows(df, renumbered=lambda i: i):
    return sorted((r.shard, r.window_no, r.n_tokens, r.n_padding, r.n_truncated, [(renumbered(p.doc_id), p.start, p.end) for p in r.pieces], r.text) for r in df.collect())


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_pack_depends_on_order_alone(spark, monkeypatch, most):
    """Sparse ids in the same order give the same windows, in whatever partitions rows come; also where starts of shards are joined."""
    monkeypatch.setattr(packing, "_MOST_STARTS", most)
    rng = np.random.RandomState(9)
    rows = [(i, " ".join(f"w{x}." if x % 9 == 0 else f"w{x}" for x in rng.randint(0, 500, rng.randint(0, 120)))) for i in range(300)]
    sparse = {i: i * i * 7_654_321 - 10**12 for i, _ in rows}
    back = {v: k for k, v in sparse.items()}
    want = windows(packing.pack(frame(spark, rows), 64, 8000))
    got = windows(packing.pack(frame(spark, [(sparse[i], t) for i, t in rows][::-1]).repartition(5), 64, 8000), back.get)
    assert want == got and len({w[0] for w in want}) > 10
    # each shard holds the documents whose bytes before them pass its multiple
    at, place = 0, {}
    for i, t in rows:
        place[i] = at // 8000
        at += len(t) + packing._ROW_BYTES
    assert {p[0]: w[0] for w in want for p in w[5]} == place


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_pack_spreads_rows_of_one_key(spark, monkeypatch, most):
    """A third of the rows are one row, another third have no id; none is lost and no shard holds them all."""
    monkeypatch.setattr(packing, "_MOST_STARTS", most)
    rows = [(7, "same text here. " * 5)] * 200 + [(None, f"no id {i}. " * 8) for i in range(200)] + [(100 + i, f"own {i}. " * 8) for i in range(200)] + [(900, None), (901, "")]
    got = packing.pack(frame(spark, rows), 64, 2000).collect()
    count = defaultdict(int)
    for r in got:
        for p in r.pieces:
            count[p.doc_id] += p.start == 0
    assert count[7] == 200 and count[None] == 200 and all(count[i] == 1 for i, _ in rows[400:])
    for key in (7, None):
        each = defaultdict(int)
        for r in got:
            each[r.shard] += sum(p.doc_id == key and p.start == 0 for p in r.pieces)
        assert max(each.values()) < 60
    assert sum(r.n_tokens + r.n_truncated for r in got) == sum(len(words(t)) for _, t in rows)


def test_context_tree_by_slices(monkeypatch):
    """Code lengths don't depend on how a home is sliced."""
    rng = np.random.RandomState(5)
    text = [bytes(rng.choice(list(b"abc "), rng.randint(0, 60)).tolist()) for _ in range(60)]
    buf, off = np.frombuffer(b"".join(text), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in text])))
    keys, counts = context_tree._part_counts(buf, off, 5)
    assert np.array_equal(context_tree._part_keys(buf, off, 5), keys)
    assert context_tree._unpack_keys(context_tree._pack_keys(keys)).tolist() == keys.tolist()
    found = []
    for size in (10**6, 7):
        monkeypatch.setattr(context_tree, "_SLICE", size)
        assert size == 10**6 or len(list(context_tree._slices(keys, 5))) > 20
        context, sums = context_tree._second(keys, counts, 5)
        _, pw = context_tree._mixed(*(sums[:, k] for k in range(3)))
        total = np.zeros((256, 3, 256))
        for k, x in enumerate((pw, sums[:, 1], sums[:, 2])):
            np.add.at(total[:, k], (context >> np.uint64(8)).astype(int), x)
        top = context_tree._top([{"latest": i, "sums": total[i].tobytes()} for i in range(256)])
        found.append(context_tree.code_lengths(keys, counts, context, sums, top, 5))
    assert np.allclose(*found) and found[0].min() > 0


VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def vocab():
    with open(VOCAB, "rb") as f:
        return bpe._vocabulary(f.read())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    with open(VOCAB, "rb") as f:
        ranks = bpe.parse(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abstrveldm' \n\t!?.0123ÄéЖ漢😀 　", max_size=30), max_size=6))
def test_bpe_agrees_with_a_tokenizer(vocab, reference, items):
    ids, off = bpe.encode_arrays(*texts.text_buffer(pa.array(items, pa.string())), vocab)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [reference.encode_ordinary(t) for t in items]
    assert bpe.decode_arrays(ids, off, vocab).to_pylist() == items


def test_bpe_frames(spark, reference):
    rows = DOCS + [(20, "a" * 5000), (21, "<|endoftext|> it's we'll"), (22, "\x00\x01 �")]
    enc = bpe.encode(clash(frame(spark, rows)), VOCAB)
    assert enc.columns[-2:] == ["token_ids", "n_tokens"] and enc.columns.count("n_tokens") == 1
    got = bpe.decode(enc, VOCAB).collect()
    assert sorted(repr((r["doc_id"], r["decoded_text"])) for r in got) == sorted(map(repr, rows))
    for r in got:
        assert r["token_ids"] == (None if r["text"] is None else reference.encode_ordinary(r["text"])) and r["n_tokens"] == len(r["token_ids"] or [])
    assert bpe.decode(bpe.encode(frame(spark, []), VOCAB), VOCAB).count() == 0


def test_decoding_bad_bytes(vocab, reference):
    ids = reference.encode_ordinary("é")
    lone = [int(vocab.byte_id[0xC3])]
    flat = np.array([*ids, *lone, *lone], np.int32)
    assert bpe.decode_arrays(flat, np.array([0, len(ids), len(ids) + 1, len(ids) + 2]), vocab).to_pylist() == ["é", "�", "�"]
    with pytest.raises(ValueError):
        bpe.decode_arrays(np.array([60_000], np.int32), np.array([0, 1]), vocab)
