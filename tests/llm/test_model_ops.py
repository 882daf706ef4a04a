"""Fitted and approximate operators, archives and media."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conformix.llm import ann, archive, media, quality, texts, toxicity
from conformix.llm.components import components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    """Documents with labels to fit on, and the rest to test on."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return docs, labels.where(~held), labels.where(held)


@pytest.mark.parametrize("fit", [lambda d, r, n: quality.fit(d, quality.grades(r), n).weights, lambda d, r, n: toxicity.fit(d, r, n).weights], ids=["quality", "toxicity"])
def test_fits_take_bounded_rows(spark, split, fit):
    """A label whose id most rows have adds no more rows than max_rows says, and repeats give the same model."""
    docs, train, _ = split
    own = docs.join(train.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    assert np.array_equal(fit(own, train, 1000), fit(own.union(docs.select(F.lit(-1).cast("long"), "text")), train, 1000))
    sample = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(400).select("doc_id")
    hot = own.join(sample, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id")).limit(1).crossJoin(spark.range(3000)).selectExpr("doc_id", "concat(text, ' ', id) as text")
    many = own.union(hot)
    first = many.join(sample, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", "text")).limit(400)
    assert np.array_equal(fit(many, train, 400), fit(first, train, 400))


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "one"), (None, "no id"), (5, "word " * 30_000), (5, "again"), (6, "ÄÖ ñ 日本")]


def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("tail", F.lit("x")).withColumn("is_toxic", F.lit("y"))
    return df.select("*", df["tail"]).toDF(*df.columns, "TEXT")


def test_cumulative_link_gradient():
    """The fit reaches a point where no small step of weights or thresholds is better."""
    rng = np.random.RandomState(0)
    buf, off = texts.text_buffer(pa.array([" ".join(rng.choice(["bad", "fair", "good", "x"], 20, p=p)) for p in ([0.5, 0.2, 0.1, 0.2], [0.2, 0.4, 0.2, 0.2], [0.1, 0.2, 0.5, 0.2]) for _ in range(60)]))
    grade = np.repeat([0, 1, 2], 60)
    idx, first = quality.features(buf, off)
    m = quality.fit_arrays(idx, first, grade, steps=400, rate=0.1)
    assert np.all(np.diff(m.bounds) > 0)

    def loss(shift):
        tails = quality.Model(m.weights, m.bounds + shift).tails(quality.scores(m.weights, idx, first))
        p = np.concatenate([np.ones((180, 1)), tails, np.zeros((180, 1))], 1)
        return -np.log(p[np.arange(180), grade] - p[np.arange(180), grade + 1]).mean()

    assert all(loss(0) <= loss(np.array(d)) + 1e-4 for d in ([0.1, 0], [0, 0.1], [-0.1, 0], [0, -0.1]))
    assert (m.tails(quality.scores(m.weights, idx, first)).sum(1).round() == grade).mean() > 0.8


def test_quality_held_out(spark, split):
    docs, train, held = split
    model = quality.fit(docs, quality.grades(train))
    got = quality.score(docs, model).join(held, "doc_id").select((F.col("tail") >= 0.5).alias("s"), "quality", "toxic").collect()
    assert np.mean([r.s == bool(r.quality) for r in got]) > 0.95
    assert np.mean([r.s for r in got if r.quality and not r.toxic]) > 0.98


def test_quality_edges(spark, split):
    docs, train, _ = split
    model = quality.fit(docs, quality.grades(train), max_rows=200)
    got = quality.score(edge(spark), model)
    assert got.columns == ["doc_id", "text", "is_toxic", "TEXT", "expected_grade", "tail"] and got.count() == len(EDGE)
    same = {(r.expected_grade, r["tail"]) for r in got.collect() if not (r.text or "").strip()}
    assert len(same) == 1 and all(0 <= r["tail"] <= 1 for r in got.collect())
    assert quality.score(edge(spark).limit(0), model).count() == 0
    with pytest.raises(ValueError):
        quality.fit(docs, quality.grades(train).where("grade = 2"))
    with pytest.raises(ValueError):
        quality.score(docs, model, at_least=3)


def test_forward_backward_is_exact():
    rng = np.random.RandomState(0)
    for _ in range(20):
        lens = rng.randint(0, 6, 4)
        first = np.concatenate(([0], np.cumsum(lens)))
        n = first[-1]
        gain, start, trans = rng.randn(n) * 2, rng.randn(2), rng.randn(2, 2)
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        want, logs, moved = np.zeros(n), 0.0, np.zeros((2, 2))
        for d, size in enumerate(lens):
            if not size:
                continue
            z, p, m = 0.0, np.zeros(size), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=int(size)):
                w = np.exp(start[y[0]] + sum(gain[first[d] + i] * y[i] for i in range(size)) + sum(trans[y[i - 1], y[i]] for i in range(1, size)))
                z += w
                p += w * np.array(y)
                for i in range(1, size):
                    m[y[i - 1], y[i]] += w
            want[first[d] : first[d + 1]] = p / z
            logs += np.log(z)
            moved += m / z
        p, lz, mv, _ = toxicity.marginals(gain, begins[:n], start, trans, pairs=True)
        assert np.allclose(p, want) and np.isclose(lz, logs) and np.allclose(mv, moved)


def test_lanes_agree_with_one_chain():
    rng = np.random.RandomState(1)
    gain, begins = rng.randn(3000), np.zeros(3000, bool)
    begins[[0, 700, 701, 2500]] = True
    start, trans = rng.randn(2), rng.randn(2, 2)
    p, _ = toxicity.marginals(gain, begins, start, trans)
    for a, b in ((0, 700), (700, 701), (701, 2500), (2500, 3000)):
        own = np.zeros(b - a, bool)
        own[0] = True
        assert np.allclose(p[a:b], toxicity.marginals(gain[a:b], own, start, trans)[0])


def test_toxicity_held_out(spark, split):
    docs, train, held = split
    model = toxicity.fit(docs, train)
    got = toxicity.tag(docs, model).join(held, "doc_id").where("quality = 1").select("is_toxic", "toxic", "toxic_spans", "text").collect()
    clean = [r for r in got if not r.toxic]
    assert np.mean([r.is_toxic for r in clean]) < 0.03
    assert np.mean([r.is_toxic for r in got if r.toxic]) > 0.6
    spans = [r.text[s.start : s.end] for r in got if r.is_toxic for s in r.toxic_spans]
    assert spans and all(s and s == s.strip() for s in spans)


def test_toxicity_edges(spark, split):
    docs, train, _ = split
    model = toxicity.fit(docs, train, max_rows=300)
    got = toxicity.tag(edge(spark), model)
    assert got.columns == ["doc_id", "text", "tail", "TEXT", "toxic_score", "is_toxic", "toxic_spans"] and got.count() == len(EDGE)
    assert all((r.toxic_score, r.is_toxic, r.toxic_spans) == (0, False, []) for r in got.collect() if not (r.text or "").strip())
    assert toxicity.tag(edge(spark).limit(0), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.fit(docs, train.limit(0))


def brute_neighbours(ids, v, asked, k=10):
    d = ann._square_distances(v[asked].astype(np.float64), v.astype(np.float64))
    d[np.arange(len(asked)), asked] = np.inf
    return {int(ids[i]): set(ids[t].tolist()) for i, t in zip(asked, np.argpartition(d, k, 1)[:, :k])}


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: [n.id for n in r.neighbours] for r in ann.neighbours(df, df.where("vec_id % 100 = 0"), list_rows=128).collect()}
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute_neighbours(ids, v, np.flatnonzero(ids % 100 == 0))
    assert set(got) == set(want) and np.mean([len(want[i] & set(got[i])) for i in want]) >= 9


@pytest.fixture(scope="module")
def clusters():
    """150,000 vectors in 1,500 clusters."""
    rng = np.random.RandomState(3)
    return (rng.randn(1500, 32)[rng.randint(0, 1500, 150_000)] + 0.35 * rng.randn(150_000, 32)).astype(np.float32)


def test_ratio_prunes_lists(clusters):
    """The ratio alone selects a few of hundreds of lists, the walk finds them, and nearly all near vectors are there."""
    lists = ann.fit_lists(clusters[:60_000], 293)
    row, home = ann.closures(clusters, lists, 0.1, 4)
    asked = np.arange(0, 150_000, 100)
    ask, at = ann.within_ratio(clusters[asked], lists, 0.15)
    probes = np.bincount(ask, minlength=len(asked))
    assert probes.min() >= 1 and probes.mean() < 0.03 * len(lists.centroids)
    near, dist = ann.search_graph(clusters[asked], lists, 16)
    true = np.sqrt(ann._square_distances(clusters[asked], lists.centroids)).min(1)
    assert np.mean(np.isclose(dist[:, 0], true, atol=1e-3)) > 0.97
    there = np.zeros((len(clusters), len(lists.centroids)), bool)
    there[row, home] = True
    hit = np.zeros((len(asked), len(lists.centroids)), bool)
    hit[ask, at] = True
    want = brute_neighbours(np.arange(150_000), clusters, asked)
    assert np.mean([(there[sorted(want[i])] & hit[r]).any(1).mean() for r, i in enumerate(asked.tolist())]) > 0.93


def test_ann_of_many_vectors(spark, clusters, tmp_path):
    """Lists that are spread over blocks, which make lists of their own; a third of the rows are copies of one vector."""
    import pyarrow.parquet as pq

    v = np.concatenate([clusters, np.tile(clusters[7], (75_000, 1))])
    table = pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 32).cast(pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = {r.vec_id: [(n.distance, n.id) for n in r.neighbours] for r in ann.neighbours(df, df.where("vec_id % 1000 = 0"), list_rows=256, sample_rows=2048, block_rows=4000).collect()}
    asked = np.arange(0, len(v), 1000)
    assert set(got) == set(asked.tolist())
    hits = []
    for i, want in brute_neighbours(np.arange(150_000), clusters, asked[:150]).items():
        hits.append(len(want & {n for _, n in got[i]}))
    assert np.mean(hits) >= 9 and all(x == sorted(x) for x in got.values())
    assert all(got[i] == [(0.0, n) for n in [7, *range(150_000, 150_010)] if n != i][:10] for i in asked[150:].tolist())


def test_graph_search_finds_near_centroids():
    rng = np.random.RandomState(2)
    c, q = rng.randn(3000, 8).astype(np.float32), rng.randn(200, 8).astype(np.float32)
    ids, dist = ann.search_graph(q, ann.build_graph(c), 16)
    true = np.argsort(ann._square_distances(q, c), 1)[:, :16]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, true)]) > 15 and (np.diff(dist, axis=1) >= 0).all()


def test_ann_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("ID", F.lit(2))
    got = {r.vec_id: [(n.id, n.distance) for n in r.neighbours] for r in ann.neighbours(df, df, k=5).collect()}
    assert got == {1: [(2, 0.0), (3, 1.0)], 2: [(1, 0.0), (3, 1.0)], 3: [(1, 1.0), (2, 1.0)]}
    assert {r.vec_id: [n.id for n in r.neighbours] for r in ann.neighbours(df, df.where("vec_id = 3"), k=1).collect()} == {3: [1]}
    other = spark.createDataFrame([(50, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [[(n.id, n.distance) for n in r.neighbours] for r in ann.neighbours(df, other, k=2).collect()] == [[(3, 1.0), (1, 2.0)]]
    assert ann.neighbours(df.limit(0), df).count() == 0 and ann.neighbours(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 3")
    assert [len(r.neighbours) for r in ann.neighbours(one, one).collect()] == [0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 75), (7, 7)]
    got = {r.id: r.group for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 75: 50, 100: 50}


def test_media(spark, tmp_path):
    rows = [(1, "<!DOCTYPE html><html lang='fr'><head><meta charset=utf-8><title>A b</title>"), (2, "plain"), (3, "plain"), (3, "plain"), (4, ""), (5, None), (None, "x"), (6, "<html>" + "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("digest", F.lit("clash")).withColumn("PAYLOAD", F.lit(1))
    root = tmp_path.as_uri()
    index = media.store(df, root)
    got = media.with_headers(index, root).collect()
    assert len(got) == 6 and len({r.digest for r in got}) == 4
    assert len({(r.shard, r.offset, r.length) for r in got if r.id in (2, 3)}) == 1
    one = next(r for r in got if r.id == 1)
    assert (one.media_type, one.lang, one.charset, one.title) == ("text/html", "fr", "utf-8", "A b")
    back = sorted((r.id, bytes(r.payload).decode()) for r in media.load(index, root).collect())
    assert back == sorted((i, x) for i, x in rows if i is not None and x is not None)
    import tarfile

    members = [m for p in tmp_path.glob("*.tar") for m in tarfile.open(p).getmembers()]
    assert len(members) == 4 and not list(tmp_path.glob("*.part"))
    assert media.store(df.limit(0), root).count() == 0


def test_headers_beyond_the_first_range(spark, tmp_path):
    """Heads that begin with long scripts or metadata, compressible or not, are read to their end."""
    noise = np.random.RandomState(1).bytes(60_000)
    page = "<html lang=fr><head><script>var a = '<title>no</title></head>%s'</script><style>%s</style><!-- </head> --><meta charset=utf-8><title>Late</title></head><body><svg><title>no</title></svg>"
    none = "<html><head><style>%s</style></head><body><svg><title>no</title></svg>" % noise.hex()
    jpg = b"\xff\xd8" + b"".join(b"\xff\xe1" + (30_002).to_bytes(2, "big") + noise[i : i + 30_000] for i in (0, 30_000)) + b"\xff\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03\x01"
    rows = [(1, (page % (noise.hex(), "b")).encode()), (2, (page % ("x" * 500_000, "y" * 9000)).encode()), (3, none.encode()), (4, jpg), (5, jpg[:40_000])]
    root = tmp_path.as_uri()
    index = media.store(spark.createDataFrame(rows, "page_id long, html binary"), root)
    got = {r.id: (r.lang, r.charset, r.title, r.width, r.height) for r in media.with_headers(index, root).collect()}
    late, nothing = ("fr", "utf-8", "Late", None, None), (None,) * 5
    assert got == {1: late, 2: late, 3: nothing, 4: (None, None, None, 32, 16), 5: nothing}


def test_header_fields():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert media.header_fields(png)["width"] == 640 and media.header_fields(png)["height"] == 480
    assert media.header_fields(b"GIF89a\x0a\x00\x14\x00")["height"] == 20
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03"
    assert (media.header_fields(jpg)["width"], media.header_fields(jpg)["height"]) == (32, 16)
    assert media.header_fields(b"")["media_type"] == "application/octet-stream"


@pytest.mark.parametrize("zip64", [True, False])
def test_package_is_a_zip_file(zip64):
    out = io.BytesIO()
    p = archive.Package(out, zip64)
    p.add("a/x.txt", [b"hello ", b"there"])
    p.add("b", [])
    p.close()
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert z.testzip() is None and z.read("a/x.txt") == b"hello there"

    class File:
        def read_at(self, n, at):
            return out.getvalue()[at : at + n]

    found = archive.central_directory(File(), len(out.getvalue()))
    assert [m.name for m in found] == ["a/x.txt", "b"]
    at = archive.data_offset(File(), found[0])
    assert out.getvalue()[at : at + found[0].stored] == b"hello there"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as w:
        w.writestr("n", "x" * 100)
        w.comment = b"PK\x05\x06 in a comment"
    raw = other.getvalue()
    File.read_at = lambda self, n, at: raw[at : at + n]
    assert [m.size for m in archive.central_directory(File(), len(raw))] == [100]
    with pytest.raises(ValueError):
        File.read_at = lambda self, n, at: b"no zip"[at : at + n]
        archive.central_directory(File(), 6)


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é"), (2, "http://a/2\r\nX: y", ""), (3, "http://a/3", "z" * 200_000), (3, "http://a/3", "again"), (None, "u", "x"), (4, None, "x"), (5, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("package", F.lit("clash")).withColumn("x", F.lit(1)).toDF("page_id", "url", "html", "package", "URL")
    root = tmp_path.as_uri()
    packages = archive.write_packages(df, root, package_bytes=200)
    got = archive.read_packages(packages, root).collect()
    assert sorted((int(r.record_id.rpartition(":")[2]), r.url, bytes(r.body).decode()) for r in got) == sorted([(1, "http://a/1", "<p>é"), (2, "http://a/2 X: y", ""), (3, "http://a/3", "z" * 200_000), (3, "http://a/3", "again")])
    assert all(r.valid for r in got)
    for p in tmp_path.glob("*.wacz"):
        assert set(zipfile.ZipFile(p).namelist()) == {"datapackage.json", archive._ARCHIVE, archive._INDEX}
    assert archive.read_packages(archive.write_packages(df.limit(0), root), root).count() == 0


def foreign(path, records, index="indexes/index.cdx.gz", compressed=True, response=False, spoil=None):
    """A package as other writers make them, by the standard library; spoil changes the archive's bytes."""
    data, lines = b"", []
    for n, (url, body) in enumerate(records):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body if response else body
        head = f"WARC/1.0\r\nWARC-Type: {'response' if response else 'resource'}\r\nWARC-Record-ID: <urn:uuid:0000-{n}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        raw = head + block + b"\r\n\r\n"
        raw = gzip.compress(raw) if compressed else raw
        digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        lines.append(f"com,example)/{n} 20240101 " + json.dumps({"url": url, "mime": "text/html", "status": "200", "digest": digest, "length": str(len(raw)), "offset": str(len(data)), "filename": "d.warc.gz"}))
        data += raw
    raw = "\n".join(["!meta 0 {}"[:7], *lines]).encode()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/d.warc.gz", spoil(data) if spoil else data)
        z.writestr(zipfile.ZipInfo(index), gzip.compress(raw) if index.endswith(".gz") else raw, zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.idx", "!meta 0 {}")
        z.writestr("datapackage.json", "{}")


def test_packages_of_other_writers(spark, tmp_path):
    pages = [(f"http://example/{i}", f"<p>é{i}".encode() * (i + 1)) for i in range(5)]
    foreign(tmp_path / "a.wacz", pages)
    foreign(tmp_path / "b.wacz", pages, "indexes/index.cdxj", compressed=False, response=True)
    foreign(tmp_path / "c.wacz", pages, spoil=lambda x: x[:40] + b"\0\0\0" + x[43:])
    foreign(tmp_path / "d.wacz", pages, spoil=lambda x: x[:-30])
    (tmp_path / "e.wacz").write_bytes(b"no package")
    with zipfile.ZipFile(tmp_path / "f.wacz", "w") as z:
        z.writestr("archive/d.warc.gz", b"x")
    names = spark.createDataFrame([(f"{c}.wacz",) for c in "abcdef"], "package string")
    got = {}
    for r in archive.read_packages(names, tmp_path.as_uri()).collect():
        got.setdefault(r.package[0], []).append(r)
    for c in "ab":
        assert sorted((r.url, bytes(r.body)) for r in got[c]) == pages and all(r.valid and r.error is None and r.record_id.startswith("urn:uuid:") and r.digest == hashlib.sha256(r.body).hexdigest() for r in got[c])
    assert len(got["c"]) == 5 and sum(not r.valid for r in got["c"]) == 1 and all((r.body is None) == (not r.valid) and (r.error is None) == r.valid for r in got["c"])
    assert len(got["d"]) == 5 and [r.valid for r in sorted(got["d"], key=lambda r: (not r.valid))] == [True] * 4 + [False]
    assert [(r.valid, r.url) for r in got["e"]] == [(False, None)] and [r.valid for r in got["f"]] == [False] and "no index line" in got["f"][0].error

