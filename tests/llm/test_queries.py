"""The registered queries over whole tables: against their SQL, or against slow versions of the same."""

import math
import re
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conformix.llm import jobs, media, quality, queries, texts, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        path = Path(f"{SF}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    own = [d[0] for d in cur.description]
    want = [[r[own.index(c)] for c in cols] for r in cur.fetchall()]
    assert sorted(own) == cols and sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(map(repr, want))


def slow_hash(codes):
    """The polynomial hash of texts, one code after the other."""
    total = sum(int(c) * pow(texts._R, i, 1 << 64) for i, c in enumerate(codes))
    return int(texts.mix(np.array([(total + len(codes)) % (1 << 64)], np.uint64))[0])


def slow_scores(model, text):
    """Expected grade and P(grade >= 1) of one text, word by word."""
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    total, recent = 0.0, []
    for n, (a, b) in enumerate(spans):
        word = raw[a:b]
        folded = texts.fold(np.frombuffer(word, np.uint8))
        h = slow_hash(texts._BYTE_CODE[folded])
        gap = raw[b : min(spans[n + 1][0] if n + 1 < len(spans) else len(raw), b + 4)]
        g = slow_hash(texts._BYTE_CODE[np.frombuffer(gap, np.uint8)]) if gap else slow_hash([])
        up, low = sum(65 <= c <= 90 for c in word), sum(97 <= c <= 122 for c in word)
        shape = 0 if not up else 3 if not low and up > 1 else 1 if not low else 2 if up > 1 else 1
        kinds = (h, g ^ 0x51, shape * 77 + min(len(word) // 3, 10), (g + shape) % (1 << 64), int(h in recent[-2:]) + 1000)
        for k, x in enumerate(kinds):
            at = int(texts.mix(np.array([(x * quality.KINDS + k) % (1 << 64)], np.uint64))[0]) >> (64 - quality.BITS)
            total += float(model.weights[at])
        recent.append(h)
    s = total / len(spans) if spans else 0.0
    tails = [1 / (1 + math.exp(b - s)) for b in model.bounds]
    return sum(tails), tails[0]


def test_op1_quality(spark):
    """Every document's numbers by a word-by-word version of the model."""
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), quality.grades(spark.read.parquet(f"{SF}/labels.parquet")))
    got = {r.doc_id: r for r in entry.queries()["op1_quality"](spark, SF).collect()}
    docs = rows_of(spark, "documents")
    assert len(got) == len(docs)
    for d in docs:
        grade, tail = slow_scores(model, d.text)
        r = got[d.doc_id]
        assert abs(r.expected_grade - grade) < 2e-5 and abs(r.tail - tail) < 2e-5 and r.selected == (r.tail >= queries.KEEP_TAIL)


def test_op1_fit_is_a_minimum():
    """No step along single weights, or along random directions of all weights, lowers the loss by more than rounding."""
    import pyarrow as pa

    rng = np.random.RandomState(0)
    buf, off = texts.text_buffer(pa.array([" ".join(rng.choice(["bad", "fair", "good", "x"], 20, p=p)) for p in ([0.5, 0.2, 0.1, 0.2], [0.2, 0.4, 0.2, 0.2], [0.1, 0.2, 0.5, 0.2]) for _ in range(60)]))
    grade, (idx, first) = np.repeat([0, 1, 2], 60), quality.features(buf, off)
    m = quality.fit_arrays(idx, first, grade, steps=800, rate=0.1)

    def loss(w):
        tails = quality.Model(w, m.bounds).tails(quality.scores(w, idx, first))
        p = np.concatenate([np.ones((180, 1)), tails, np.zeros((180, 1))], 1)
        return -np.log(p[np.arange(180), grade] - p[np.arange(180), grade + 1]).mean()

    base, used = loss(m.weights), np.unique(idx)
    for col in used:
        for step in (-0.05, 0.05):
            w = m.weights.copy()
            w[col] += step
            assert loss(w) > base - 2e-4
    for _ in range(10):
        w = m.weights.copy()
        w[used] += rng.randn(len(used)) * 0.05
        assert loss(w) > base - 2e-4


class Head(HTMLParser):
    """Language, charset and title by the standard library."""

    def __init__(self):
        super().__init__()
        self.lang = self.charset = self.title = None
        self.inside = self.over = False

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "html":
            self.lang = self.lang or found.get("lang")
        if self.over or tag == "body":
            self.over = True
            return
        if tag == "meta":
            self.charset = self.charset or found.get("charset")
        self.inside = tag == "title" and self.title is None

    def handle_endtag(self, tag):
        self.over |= tag == "head"
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title = (self.title or "") + data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_op6_media(spark, con):
    """Digests and sizes by SQL; metadata of every page by an HTML parser."""
    got = {r.page_id: r for r in entry.queries()["op6_media"](spark, SF).collect()}
    want = con.execute("SELECT page_id, sha256(html), strlen(html), html FROM pages WHERE html IS NOT NULL").fetchall()
    assert len(got) == len(want)
    for id_, digest, size, html in want:
        r = got[id_]
        assert (r.digest, r.n_bytes) == (digest, size)
        if r.media_type == "text/html":
            head = Head()
            head.convert_charrefs = False
            head.feed(html)
            assert (r.lang, r.charset, r.title) == (head.lang, head.charset, head.title and head.title.strip())
    assert any(r.title for r in got.values())


def test_op2_spans_are_the_planted_ones(spark):
    """Fitted to labels of whole documents, the field finds phrases in texts that it hasn't seen."""
    rng = np.random.RandomState(8)
    plain = [f"{a}{b}" for a in ("mor", "tel", "sun", "bri", "kal", "vop") for b in ("a", "en", "ito", "us", "ade", "ion", "ell", "ard")]
    foul = [f"{a}{b}" for a in ("zgrak", "xulk", "qvarg") for b in ("a", "en", "ito", "us")]

    def document(toxic):
        words, marks = [], []
        for _ in range(rng.randint(30, 90)):
            words.append(str(rng.choice(plain)))
            marks.append(False)
            if toxic and rng.rand() < 0.06:
                for _ in range(rng.randint(1, 4)):
                    words.append(str(rng.choice(foul)))
                    marks.append(True)
        if toxic and not any(marks):
            words.append(foul[0])
            marks.append(True)
        return words, marks

    toxic = [i % 3 == 0 for i in range(600)]
    made = [document(t) for t in toxic]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic[:300])], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.tag(docs, toxicity.fit(docs, labels)).where("doc_id >= 300").collect()}
    right = found = planted = 0
    for i in range(300, 600):
        words, marks = made[i]
        at = np.cumsum([0] + [len(w) + 1 for w in words])
        spans = {(int(a), int(a) + len(w)) for a, w, m in zip(at, words, marks) if m}
        own = {(int(a), int(a) + len(w)) for a, w in zip(at, words) if any(s.start <= a and a + len(w) <= s.end for s in got[i].toxic_spans)}
        right, found, planted = right + len(spans & own), found + len(own), planted + len(spans)
        assert got[i].is_toxic == toxic[i]
        for s in got[i].toxic_spans:
            assert s.start in {int(a) for a in at} and 0.5 <= s.score <= 1
    assert right / planted > 0.95 and right / found > 0.95


def test_pipeline_is_its_stages(spark):
    """run() against the stages' definitions: selections by the two models, sets compared with all sets, windows of 50 words, and texts in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = quality.fit(docs, quality.grades(labels))
    left = {d.doc_id: d.text for d in docs.collect() if slow_scores(first, d.text)[1] >= queries.KEEP_TAIL}
    rest = docs.where(docs["doc_id"].isin(list(left)))
    second = toxicity.tag(rest, toxicity.fit(rest, labels))
    left = {r.doc_id: r.text for r in second.where("not is_toxic").collect()}
    words = {i: [w.lower() for w in WORD.findall(t or "")] for i, t in left.items()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()) for i, w in words.items()}
    group = {i: i for i in left}
    for _ in left:
        before = dict(group)
        for a in left:
            for b in left:
                if a < b and sets[a] and len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_JACCARD * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    left = {i: t for i, t in left.items() if group[i] == i}
    owner = {}
    for i in sorted(left):
        for k in range(len(words[i]) - 49):
            owner.setdefault(tuple(words[i][k : k + 50]), i)
    for i, t in list(left.items()):
        gone = set()
        for k in range(len(words[i]) - 49):
            if owner[tuple(words[i][k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        spans = [m.span() for m in WORD.finditer(t or "")]
        if gone:
            ends = [a for a, _ in spans[1:]] + [len(t)]
            left[i] = t[: spans[0][0]] + "".join(t[a:e] for k, ((a, _), e) in enumerate(zip(spans, ends)) if k not in gone)
    out = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.shard, r.window_no))
    order, pieces = [], {}
    for r in out:
        for p in r.pieces:
            if p.doc_id not in pieces:
                order.append(p.doc_id)
            pieces.setdefault(p.doc_id, []).append((left[p.doc_id] or "")[p.start : p.end])
    assert order == sorted(left)
    assert sum(r.n_tokens + r.n_truncated for r in out) == sum(len(WORD.findall(t or "")) for t in left.values())
    if not any(r.n_truncated for r in out):
        assert {i: "".join(x) for i, x in pieces.items()} == {i: t or "" for i, t in left.items()}
    jobs.clear(spark)


def test_texts_longer_than_a_chunk(spark):
    """A text of 2.5 MB, longer than what kernels hold at once, its copy, and one with its second half."""
    from conformix.llm import bpe, context_tree, ngram_join, packing, substring_dedup

    rng = np.random.RandomState(3)
    size = int(2.5 * (1 << 20)) // 7
    assert texts.CHUNK_BYTES < size * 7
    words = [f"w{x:05d}" for x in rng.randint(0, 100_000, size)]
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long), (2, long), (3, " ".join(words[size // 2 :]) + " and an end"), (4, "a short text")], "doc_id long, text string")
    joined = {r.doc_id: tuple(r)[1:] for r in ngram_join.ngram_jaccard_join(docs, 0.4).collect()}
    assert joined == {1: (1, 1, 1, 1), 2: (1, 1, 1, 1), 3: (3, 0, 1, 1), 4: (4, 0, 0, 4)}
    cut = {r.doc_id: (r.text, r.removed_words) for r in substring_dedup.substring_dedup(docs).collect()}
    assert cut == {1: (long, 0), 2: ("", size), 3: ("and an end", size - size // 2), 4: ("a short text", 0)}
    bits = {r.doc_id: r for r in context_tree.score(docs).collect()}
    assert bits[1].code_bits == bits[2].code_bits and bits[1].n_bytes == len(long) and bits[4].bits_per_byte > bits[1].bits_per_byte
    packed = packing.pack(docs).collect()
    assert sum(r.n_tokens + r.n_truncated for r in packed) == 2 * size + size - size // 2 + 3 + 3
    coded = bpe.decode(bpe.encode(docs, queries.RANKS_PATH), queries.RANKS_PATH)
    assert coded.where("decoded_text <=> text").count() == 4
    model = quality.Model(rng.randn(1 << quality.BITS).astype(np.float32), np.array([0.0, 1.0]))
    assert {r.expected_grade for r in quality.score(docs.where("doc_id < 3"), model).collect()} != set()
    one = {r.doc_id: r["tail"] for r in quality.score(docs, model).collect()}
    assert one[1] == one[2] and abs(one[1] - 1 / (1 + math.exp(-float(quality.scores(model.weights, *quality.features(*_buffer(long)))[0])))) < 1e-5
    field = toxicity.Model(rng.randn(1 << toxicity.BITS).astype(np.float32), np.array([0.0, -1.0]), np.array([[0.0, -1.0], [0.0, 0.0]]), 0.5)
    tagged = {r.doc_id: (r.toxic_score, len(r.toxic_spans)) for r in toxicity.tag(docs, field).collect()}
    assert tagged[1] == tagged[2] and tagged[1][1] > 1000


def _buffer(text):
    import pyarrow as pa

    return texts.text_buffer(pa.array([text]))


def test_media_payloads_are_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "<html><title>x</title>" + "y" * 3_000_000), (2, None), (3, "")], "page_id long, html string")
    index = media.store(df, tmp_path.as_uri())
    assert {r.id: len(r.payload) for r in media.load(index, tmp_path.as_uri()).collect()} == {1: 3_000_022, 3: 0}
