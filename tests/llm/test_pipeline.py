"""The corpus pipeline: stages on the driver's tables, on edited copies, and on odd rows and columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conformix.llm import jobs

SF = "/root/testdata/sf0.01"


def test_pipeline(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        gone = before - now
        if i == 0:
            assert np.mean([labels[d][0] == 0 for d in gone if d in labels]) > 0.95
        if i == 1:
            assert gone and np.mean([labels[d][1] == 1 for d in gone if d in labels]) > 0.9
        if i == 3:
            assert not gone
        before = now
    windows = corpus_pipeline.pack_windows(spark, docs, SF)
    assert {p.doc_id for r in windows.collect() for p in r.pieces} == before


def test_near_copies_of_edited_texts(spark):
    """Copies with 5 to 10 % of their words edited go; unrelated texts and texts with a half in common stay."""
    rng = np.random.RandomState(6)
    prose = lambda n: [f"w{int(x)}" for x in 2000 * rng.rand(n) ** 2]
    rows, stay = [], set()

    def add(own, kept):
        rows.append((len(rows), " ".join(own)))
        if kept:
            stay.add(len(rows) - 1)

    for n in (10, 20, 47, 120, 400):
        for rate in (0.05, 0.075, 0.1):
            base = prose(n)
            add(base, True)
            for even in (True, False):
                for kind in ("replaced", "put in", "left out"):
                    own, k = list(base), int(rate * n + 1e-9)
                    at = [int((i + 0.5) * n / k) for i in range(k)] if even else rng.choice(n, k, False).tolist()
                    for i in sorted(at, reverse=True):
                        own[i : i + (kind != "put in")] = [] if kind == "left out" else [f"new{rng.randint(1 << 30)}"]
                    add(own, False)
    for n in (10, 47, 120, 400):
        for _ in range(10):
            add(prose(n), True)
        half = prose(n // 2)
        add(half + prose(n // 2), True)
        add(half + prose(n // 2), True)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (9999, None)], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == stay | {None, 9999}


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


ODD = ["tail", "expected_grade", "toxic_score", "is_toxic", "toxic_spans", "removed_words", "removed", "id", "class_id", "group_id", "TEXT", "DOC_ID", "c0", "bucket"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of sf0.001 with repeated rows, NULLs and empty texts, without and with columns whose names clash."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.limit(5)).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    docs = docs.union(spark.createDataFrame([(9001, "", "en", "s", 0), (9002, " \n", "en", "s", 2), (9003, "one", "en", "s", 3), (9003, "one", "en", "s", 3)], docs.schema))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    more = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("source")).alias(f"x{i}") for i, c in enumerate(ODD)])
    return docs, more.toDF(*docs.columns, *ODD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_columns_apart(spark, odd, name):
    """Extra columns keep their values, and rows are decided as without them."""
    stage, (docs, more) = dict(corpus_pipeline.STAGES)[name], odd
    want, got = stage(spark, docs, "/root/testdata/sf0.001"), stage(spark, more, "/root/testdata/sf0.001")
    if name == "packing":
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        return
    assert got.columns == more.columns and [f.dataType for f in got.schema] == [f.dataType for f in more.schema]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(repr(r[:5]) for r in rows) == sorted(map(repr, map(tuple, want.collect())))
    assert all(r[5 + i] == f"{c}:{r[3]}" for r in rows for i, c in enumerate(ODD))
    assert {r[0] for r in rows} >= {9001, 9002, 9003, None} or name in ("quality", "toxicity")
    for missing in ("text",) if name in ("quality", "toxicity") else ("text", "doc_id"):
        with pytest.raises(ValueError, match="no column"):
            stage(spark, docs.drop(missing), "/root/testdata/sf0.001").count()


def test_stages_without_labels(spark, tmp_path):
    """With one grade, or no toxic document, the fitted stages keep all rows; without the table they fail."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1 and toxic = 0").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.keep_civil):
        assert stage(spark, docs, str(tmp_path)).exceptAll(docs).count() == 0 and stage(spark, docs, str(tmp_path)).count() == docs.count()
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            stage(spark, docs, str(tmp_path / "none"))


def test_run_and_clear(spark):
    """All stages in a row; what they stored can be cleared afterwards."""
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {p.doc_id for r in out.collect() for p in r.pieces}
    assert ids and ids < {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    jobs.clear(spark)
    assert not jobs._kept[spark.sparkContext.applicationId]
