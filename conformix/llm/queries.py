"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, archive, bpe, context_tree, jobs, media, ngram_join, packing, quality, substring_dedup, toxicity


#: Ranks of a public byte-level tokenizer, on the driver.
RANKS_PATH = os.environ.get("CONFORMIX_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Documents are selected if they are good with at least this probability.
KEEP_TAIL = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "expected_grade", "tail", (scored["tail"] >= KEEP_TAIL).alias("selected"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, model).select("doc_id", "toxic_score", "is_toxic", "toxic_spans")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
    found = found.select("vec_id", F.posexplode("neighbours").alias("rank", "n"))
    return found.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.col("n.distance").alias("distance"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = jobs.scratch(spark, "media")
    index = media.store(table(spark, sf_dir, "pages"), root)
    return media.with_headers(index, root).withColumnRenamed("id", "page_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = jobs.scratch(spark, "wacz")
    packages = archive.write_packages(table(spark, sf_dir, "pages"), root)
    records = archive.read_packages(packages, root)
    return records.select(F.regexp_extract("record_id", r"(\d+)$", 1).cast("long").alias("page_id"), "url", "n_bytes", "digest", "valid", records["body"].cast("string").alias("html"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, RANKS_PATH), RANKS_PATH)
    return both.select("doc_id", "n_tokens", "token_ids", both["decoded_text"].eqNullSafe(both["text"]).alias("round_trip"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_context_tree": op3_context_tree,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_ann": op5_ann,
    "op6_media": op6_media,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) >= 1 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
s AS (SELECT doc_id, string_agg(gram, '|' ORDER BY gram) AS grams, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT grams, n, min(doc_id) AS class_id, count(*) - 1 AS n_copies FROM s GROUP BY grams, n),
r AS (SELECT class_id, n, gram FROM c JOIN g ON g.doc_id = class_id),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM r a JOIN r b ON a.gram = b.gram AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.7),
l AS (SELECT a AS class_id, count(*) AS n_links FROM p GROUP BY a),
reach AS (SELECT DISTINCT a, a AS b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
k AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(group_id, c.class_id, d.doc_id) AS group_id
FROM (SELECT DISTINCT doc_id FROM w) d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.grams = s.grams LEFT JOIN l ON l.class_id = c.class_id LEFT JOIN k ON k.class_id = c.class_id
""",
    # with one list, as at this size, the search is exact
    "op5_ann": r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_distance(a.v, b.v), 6) AS distance FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour)::INTEGER AS rank FROM d)
SELECT vec_id, rank, neighbour, distance FROM k WHERE rank <= 10
""",
    "op7_warc": r"""
SELECT page_id, url, strlen(html) AS n_bytes, sha256(html) AS digest, TRUE AS valid, html FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL
""",
    "op8_substring_dedup": r"""
WITH t AS (SELECT doc_id, text, lang, source, n_chars, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS ws,
    regexp_extract(text, '^[\x00-/:-@\[-`{-\x7f]*') AS head, regexp_extract_all(text, '[^\x00-/:-@\[-`{-\x7f]+[\x00-/:-@\[-`{-\x7f]*') AS pieces FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE len(ws) >= 50)),
f AS (SELECT win, min(doc_id) AS owner FROM w GROUP BY win HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (win) WHERE doc_id > owner),
kept AS (SELECT u.doc_id, string_agg(u.piece, '' ORDER BY u.p) AS rest, count(*) AS n FROM (SELECT doc_id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS p FROM t) u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY u.doc_id),
r AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN r.removed IS NULL THEN t.text ELSE t.head || coalesce(k.rest, '') END AS text, t.lang, t.source,
    CASE WHEN r.removed IS NULL THEN t.n_chars ELSE length(t.head || coalesce(k.rest, '')) END AS n_chars, coalesce(r.removed, 0) AS removed_words
FROM t LEFT JOIN r ON t.doc_id = r.doc_id LEFT JOIN kept k ON t.doc_id = k.doc_id
""",
}
